"""FASTA files as tables.

Lines keep their order by (split of the file, id within the split).  Record numbers and offsets are running sums that
are made within each split and shifted by the sums of the splits before it, so no window spans the file.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.errors import InvalidInput, MalformedInput
from seqloom.functions.bases import first_offender, upper_bases, upper_sign
from seqloom.operators.sequence import contigs_of, length_of, pieces_of, slice_pieces, with_offsets
from seqloom.plans.durable import materialise
from seqloom.plans.region import Region
from seqloom.sources import bgzf
from seqloom.sources.byte_ranges import raw_lines, running, stamps

log = logging.getLogger(__name__)

EXTENSIONS = ("fasta", "fa", "fna")


@dataclass(frozen=True)
class Sequence:
    """One axis: pieces of bases, the contigs they come from, their length and what they are called."""

    pieces: DataFrame
    contigs: DataFrame
    length: int
    label: Region
    multi: bool
    #: Whether the label is the region it was cut to.
    cut: bool = False
    #: Whether all bases are in upper case.
    upper: bool = True


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(split, line_no, line) of a text file, or of a folder's files in order of their names; only line feeds part lines, one
    carriage return before them is dropped.  A block-gzip file is read by many tasks, a plain gzip file by one."""
    lines = raw_lines(spark, path)
    if path.lower().endswith(".gz"):
        file = stamps(spark, path).select("file").first()
        if file is not None and bgzf.is_bgzf(file["file"]):
            lines = bgzf.raw_lines(spark, path)
        else:
            log.warning("%s isn't block gzip and is read by one task", path)
    return lines.select("split", "line_no", F.regexp_replace("value", "\r$", "").alias("line"))


def header_id(line: Column) -> Column:
    """First token behind the mark, empty if there is none."""
    return F.regexp_extract(line, r"^>\s*(\S+)", 1)


def parse_fasta(lines: DataFrame, preserve_case: bool = False) -> DataFrame:
    """(split, line_no, rec, header, bases) of every line but comments; bases before the first header belong to record 1."""
    kept = lines.where(~F.col("line").startswith(";"))
    is_header = F.col("line").startswith(">")
    numbered = running(kept, is_header.cast("int"), "rec", inclusive=True)
    bases = F.col("line") if preserve_case else upper_bases(F.col("line"))
    return numbered.select(
        "split", "line_no", F.greatest("rec", F.lit(1)).alias("rec"), F.when(is_header, header_id(F.col("line"))).alias("header"), F.when(is_header, F.lit("")).otherwise(bases).alias("bases")
    )


def contigs_of_lines(parsed: DataFrame) -> DataFrame:
    """(ord, id, n, off) of the records of a parsed file."""
    counted = parsed.groupBy(F.col("rec").alias("ord")).agg(F.max("header").alias("id"), F.sum(F.length("bases")).cast("long").alias("n"))
    return with_offsets(counted)


def placed_lines(parsed: DataFrame) -> DataFrame:
    """Pieces (pos, bases) of a parsed file."""
    return running(parsed, F.length("bases"), "pos", inclusive=False).where("bases <> ''").select("pos", "bases")


def violations(parsed: DataFrame, preserve_case: bool = False) -> DataFrame:
    """(split, line_no, problem) of lines that are no FASTA; a symbol is named in upper case."""
    offender = first_offender(F.col("bases"))
    offender = offender if preserve_case else upper_sign(offender)
    problem = F.when(F.col("header") == "", F.lit("missing identifier")).when(offender == "-", F.lit("gaps ('-') are not supported, use N")).when(offender != "", F.concat(F.lit("invalid symbol "), offender))
    return parsed.withColumn("problem", problem).where("problem IS NOT NULL").select("split", "line_no", "problem")


def read_sequence(spark: SparkSession, path: str, region: Region | None = None, preserve_case: bool = False) -> Sequence | None:
    """The (cut) sequence of a file, None where the region holds none; what lies behind the region isn't checked."""
    parsed = materialise(parse_fasta(read_lines(spark, path), preserve_case), "fasta")
    contigs = materialise(contigs_of_lines(parsed), "fasta-contigs")
    if contigs.where("id IS NOT NULL").limit(1).count() == 0:
        raise MalformedInput("no FASTA header")
    last = None
    if region is not None and region.kind != "slice":
        last = contigs.where(F.col("id") == region.id).agg(F.min("ord")).first()[0]
    elif region is not None:
        last = contigs.where(F.col("off") < region.end).agg(F.max("ord")).first()[0]
    seen = parsed if last is None else parsed.where(F.col("rec") <= last)
    bad = violations(seen, preserve_case).orderBy("split", "line_no").limit(1).collect()
    if bad:
        raise MalformedInput(bad[0]["problem"])
    return _cased(cut_sequence(placed_lines(parsed), contigs, region), preserve_case)


def sequence_of_records(records: DataFrame, region: Region | None = None, preserve_case: bool = False) -> Sequence | None:
    """As ``read_sequence``, from a table (ord, id, seq)."""
    contigs = contigs_of(records if preserve_case else records.withColumn("seq", F.upper("seq")))
    return _cased(cut_sequence(pieces_of(contigs), contigs.drop("seq"), region), preserve_case)


def _cased(found: Sequence | None, preserve_case: bool) -> Sequence | None:
    return replace(found, upper=not preserve_case) if found else None


def cut_sequence(pieces: DataFrame, contigs: DataFrame, region: Region | None) -> Sequence | None:
    """Apply a region to a whole sequence; the contigs kept are those up to the region's end."""
    if region is None:
        totals = contigs.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("id").alias("id")).first()
        if totals["n"] == 0:
            return None
        label = Region(id=totals["id"]) if totals["k"] == 1 else Region(None, 0, totals["n"])
        return Sequence(pieces, contigs, totals["n"], label, totals["k"] > 1)
    if region.kind == "slice":
        kept = contigs.where(F.col("off") < region.end)
        cut = slice_pieces(pieces, region.start, region.end)
        length = length_of(cut)
        return Sequence(cut, kept, length, region, kept.limit(2).count() > 1, True) if length else None
    found = contigs.where(F.col("id") == region.id).orderBy("ord").limit(1).collect()
    if not found or found[0]["n"] == 0:
        return None
    own = found[0]
    start, end = (0, own["n"]) if region.kind == "id" else (region.start, region.end)
    if end > own["n"]:
        return None
    cut = slice_pieces(pieces, own["off"] + start, own["off"] + end)
    return Sequence(cut, contigs.where(F.col("ord") <= own["ord"]), end - start, region, own["ord"] > contigs.agg(F.min("ord")).first()[0], True)


def check_extension(path: str, extensions: tuple[str, ...]) -> str:
    """The extension of a path (a trailing .gz aside), which must be a known one."""
    name = path.rsplit("/", 1)[-1].lower().removesuffix(".gz")
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    if ext not in extensions:
        raise InvalidInput(f"unknown file extension of {path!r}, expected one of {', '.join(extensions)}")
    return ext
