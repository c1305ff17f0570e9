"""An index of FASTA files: where the bases of each record lie, so that a region reads its own bytes only.

A row for each record: its number, id, bases and offset, and, where all its lines but the last are equally long, the byte
of its first base with the bases and bytes of a line, from which the byte of any base follows.  Records whose lines are
uneven, or have comments or blank lines between, are marked; a region that needs one of those, a store that pyarrow can't
open, or files that have changed since are read by the full scan instead, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.errors import InvalidInput, MalformedInput
from seqloom.functions.bases import first_offender, upper_bases, upper_sign
from seqloom.operators.sequence import with_offsets
from seqloom.plans.region import Region
from seqloom.sources.byte_ranges import CHUNK, placed, raw_lines, read_ranges, readable, running, same_files, spread, stamps
from seqloom.sources.fasta import Sequence, header_id, read_sequence

INDEX = "ord long, id string, n long, off long, file string, at long, line_bases long, line_bytes long, even boolean"


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """INDEX of the records of a file or of a folder's files."""
    lines = placed(raw_lines(spark, path))
    header, comment = F.col("line").startswith(">"), F.col("line").startswith(";")
    numbered = running(lines.withColumn("line", F.regexp_replace("value", "\r$", "")), header.cast("int"), "rec", inclusive=True)
    size = F.when(header | comment, 0).otherwise(F.length("line")).cast("long")
    rows = numbered.select(F.greatest("rec", F.lit(1)).alias("ord"), F.when(header, header_id(F.col("line"))).alias("id"), size.alias("size"), F.col("split.file").alias("file"), "at", "bytes")

    def where(condition: Column, value: Column) -> Column:
        return F.when(condition, value)

    body = F.col("size") > 0
    own = rows.groupBy("ord").agg(
        F.max("id").alias("id"), F.sum("size").alias("n"), F.count(where(body, F.col("at"))).alias("lines"),
        F.min(where(body, F.col("at"))).alias("first"), F.max(where(body, F.col("at"))).alias("last"), F.max_by(where(body, F.col("size")), where(body, F.col("at"))).alias("tail"),
        F.max(where(body, F.col("size"))).alias("line_bases"), F.max(where(body, F.col("bytes"))).alias("most"), F.min_by(where(body, F.col("bytes")), where(body, F.col("at"))).alias("line_bytes"),
        (F.sum(where(body, F.col("bytes"))) - F.max_by(where(body, F.col("bytes")), where(body, F.col("at")))).alias("before_last"),
        F.min(where(body, F.col("file"))).alias("file"), F.max(where(body, F.col("file"))).alias("other_file"),
    )
    # no line but the last is shorter than the longest, in bases and in bytes, and nothing lies between: sums tell
    full = F.col("n") - F.col("tail") == (F.col("lines") - 1) * F.col("line_bases")
    steps = F.col("last") - F.col("first") == (F.col("lines") - 1) * F.col("line_bytes")
    widest = (F.col("most") == F.col("line_bytes")) | (F.col("lines") == 1)
    unbroken = F.col("last") - F.col("first") == F.col("before_last")
    even = F.coalesce(full & steps & widest & unbroken & (F.col("file") == F.col("other_file")), F.lit(True))
    return with_offsets(own.withColumn("even", even)).select("ord", "id", "n", "off", "file", F.col("first").alias("at"), "line_bases", "line_bytes", "even")


def write_index(spark: SparkSession, path: str, index_path: str) -> None:
    """Index ``path`` and keep the index with the files' stamps as two Parquet tables."""
    index_of(spark, path).write.mode("overwrite").parquet(f"{index_path}/records")
    stamps(spark, path).write.mode("overwrite").parquet(f"{index_path}/files")


def region_ranges(contigs: DataFrame, start: int, end: int, chunk: int | None = None) -> DataFrame:
    """(file, start, stop, pos): the byte ranges of bases start to end of the whole, pos counting from 0; each range has
    whole lines of about ``chunk`` bytes at most."""
    lo, hi = F.greatest(F.lit(start) - F.col("off"), F.lit(0)), F.least(F.lit(end) - F.col("off"), F.col("n"))
    own = contigs.where((F.col("off") < end) & (F.col("off") + F.col("n") > start) & (F.col("n") > 0)).select("*", lo.alias("lo"), hi.alias("hi"))
    step = F.greatest(F.lit(1), F.floor(F.lit(chunk or CHUNK) / F.col("line_bytes"))) * F.col("line_bases")
    cuts = own.withColumn("step", step).withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / F.col("step")), F.floor((F.col("hi") - 1) / F.col("step")))))
    cuts = cuts.withColumns({"a": F.greatest("lo", F.col("k") * F.col("step")), "b": F.least("hi", (F.col("k") + 1) * F.col("step")) - 1})

    def byte(base: Column) -> Column:
        return F.col("at") + F.floor(base / F.col("line_bases")) * F.col("line_bytes") + base % F.col("line_bases")

    return cuts.select("file", byte(F.col("a")).alias("start"), (byte(F.col("b")) + 1).alias("stop"), (F.col("off") + F.col("a") - start).alias("pos"))


def read_indexed(spark: SparkSession, path: str, index_path: str, region: Region, preserve_case: bool = False) -> Sequence | None:
    """As ``read_sequence`` with a region, from the region's bytes; only those are checked for symbols."""
    contigs = spark.read.schema(INDEX).parquet(f"{index_path}/records")
    if not same_files(spark, path, spark.read.parquet(f"{index_path}/files")):
        return read_sequence(spark, path, region, preserve_case)
    if contigs.where("id IS NOT NULL").isEmpty():
        raise MalformedInput("no FASTA header")
    if region.kind == "slice":
        start, end = region.start, region.end
        kept = contigs.where(F.col("off") < end)
        end = min(end, contigs.agg(F.coalesce(F.max(F.col("off") + F.col("n")), F.lit(0))).first()[0])
        multi = kept.limit(2).count() > 1
    else:
        own = contigs.where(F.col("id") == region.id).orderBy("ord").limit(1).collect()
        if not own or own[0]["n"] == 0:
            return None
        lo, hi = (0, own[0]["n"]) if region.kind == "id" else (region.start, region.end)
        if hi > own[0]["n"]:
            return None
        start, end = own[0]["off"] + lo, own[0]["off"] + hi
        kept = contigs.where(F.col("ord") <= own[0]["ord"])
        multi = own[0]["ord"] > contigs.agg(F.min("ord")).first()[0]
    if end <= start:
        return None
    touched = contigs.where((F.col("off") < end) & (F.col("off") + F.col("n") > start) & (F.col("n") > 0))
    one = touched.select("file").limit(1).collect()
    if not readable(one[0]["file"]) or not touched.where(~F.col("even")).isEmpty():
        return read_sequence(spark, path, region, preserve_case)
    raw = read_ranges(spread(region_ranges(touched, start, end)), b"\r\n")
    text = F.col("raw").cast("string")
    pieces = raw.select("pos", (text if preserve_case else upper_bases(text)).alias("bases"))
    sign = first_offender(F.col("bases"))
    bad = pieces.select("pos", (sign if preserve_case else upper_sign(sign)).alias("sign")).where("sign <> ''").orderBy("pos").limit(1).collect()
    if bad:
        raise MalformedInput("gaps ('-') are not supported, use N" if bad[0]["sign"] == "-" else f"invalid symbol {bad[0]['sign']}")
    columns = kept.select("ord", "id", "n", "off")
    return Sequence(pieces, columns, end - start, region, multi, True, not preserve_case)


def check_index(spark: SparkSession, path: str, index_path: str) -> None:
    """Raise where the files have changed since they were indexed."""
    if not same_files(spark, path, spark.read.parquet(f"{index_path}/files")):
        raise InvalidInput(f"{path!r} has changed since it was indexed")
