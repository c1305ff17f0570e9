"""A block index of track files: which bytes hold which positions of which chromosome.

Lines are grouped to blocks of about BLOCK bytes; a row for each block and chromosome in it says where those lines begin
and end in the file and which positions they span.  A region reads only the blocks whose span meets it.  That is exact
for any order of lines; in a sorted file spans hardly overlap, so a region reads a few blocks, which ``is_sorted`` tells.
An index is made of whole files, whose lines are all checked; files that changed since are scanned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.errors import MalformedInput
from seqloom.sources.byte_ranges import lines_of_ranges, placed, raw_lines, readable, same_files, spread, stamps
from seqloom.sources.fasta import check_extension
from seqloom.sources.track import FORMATS, good_rows, parse_lines, read_track

BLOCK = 1 << 20
INDEX = "file string, block long, chrom string, start long, stop long, lo long, hi long, lines long, descents long"


def index_of(spark: SparkSession, path: str, block: int = BLOCK, fmt: str | None = None) -> DataFrame:
    """INDEX of a track file, or of a folder's files; the first malformed line raises.

    descents counts lines that lie before the line above them, of the same chromosome and the same part of the file.
    """
    fmt = fmt or check_extension(path, FORMATS)
    lines = placed(raw_lines(spark, path))
    own = F.struct("split", F.col("line_no").alias("no"), "at", "bytes")
    parsed = parse_lines(lines.select(own.alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line")), fmt)
    bad = parsed.where("problem IS NOT NULL").orderBy("line_no.split", "line_no.no").limit(1).collect()
    if bad:
        raise MalformedInput(bad[0]["problem"])
    rows = parsed.select("line_no.*", "chrom", F.col("start").alias("pos"))
    before = Window.partitionBy("split").orderBy("no")
    rows = rows.withColumn("down", (F.lag("chrom").over(before) == F.col("chrom")) & (F.lag("pos").over(before) > F.col("pos")))
    keys = [F.col("split.file").alias("file"), F.floor(F.col("at") / block).alias("block"), "chrom"]
    ends = [F.min("at").alias("start"), F.max(F.col("at") + F.col("bytes")).alias("stop"), F.min("pos").alias("lo"), F.max("pos").alias("hi")]
    return rows.groupBy(*keys).agg(*ends, F.count("*").alias("lines"), F.count_if("down").alias("descents"))


def write_index(spark: SparkSession, path: str, index_path: str, block: int = BLOCK, fmt: str | None = None) -> None:
    """Index ``path`` and keep the index with the files' stamps as two Parquet tables."""
    index_of(spark, path, block, fmt).repartition("chrom").sortWithinPartitions("chrom", "lo").write.mode("overwrite").parquet(f"{index_path}/blocks")
    stamps(spark, path).write.mode("overwrite").parquet(f"{index_path}/files")


def is_sorted(index: DataFrame) -> bool:
    """Whether the lines of each chromosome lie in order of their positions, block after block."""
    order = Window.partitionBy("chrom").orderBy("file", "block")
    return index.withColumn("next", F.lead("lo").over(order)).where((F.col("descents") > 0) | (F.col("next") < F.col("hi"))).isEmpty()


def region_ranges(index: DataFrame, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(file, start, stop) of the blocks that may hold positions start to end (exclusive) of a chromosome."""
    met = index.where(F.col("chrom") == chrom)
    met = met if start is None else met.where(F.col("hi") >= start)
    met = met if end is None else met.where(F.col("lo") < end)
    return met.select("file", "start", "stop")


def read_region(spark: SparkSession, path: str, index_path: str, chrom: str, start: int | None = None, end: int | None = None, fmt: str | None = None) -> DataFrame:
    """(line_no, chrom, start, end, value) of a track's rows on a chromosome that begin in start to end (exclusive); line_no
    orders rows as the files do."""
    fmt = fmt or check_extension(path, FORMATS)
    index = spark.read.schema(INDEX).parquet(f"{index_path}/blocks")
    fresh = same_files(spark, path, spark.read.parquet(f"{index_path}/files"))
    ranges = region_ranges(index, chrom, start, end)
    one = ranges.select("file").limit(1).collect() if fresh else []
    if fresh and (not one or readable(one[0]["file"])):
        lines = lines_of_ranges(spread(ranges)).select(F.struct("file", "at").alias("line_no"), "line")
        rows = good_rows(parse_lines(lines, fmt, chrom))
    else:
        rows = read_track(spark, path, chrom, fmt)
    rows = rows if start is None else rows.where(F.col("start") >= start)
    return rows if end is None else rows.where(F.col("start") < end)
