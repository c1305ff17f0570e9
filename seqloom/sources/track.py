"""Methylation tracks: bedMethyl and bedGraph lines as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.errors import InvalidInput, MalformedInput
from seqloom.sources.fasta import check_extension, read_lines



@dataclass(frozen=True)
class LineFormat:
    """A format of track lines: the names of its columns as errors name them; the last one is the value's, the first three
    are chromosome, start and end."""

    columns: tuple[str, ...]


#: Names of the columns in error messages.
COLUMNS = {
    "bed": ("Chrom", "ChromStart", "ChromEnd", "Modified Base Code (Name)", "Score", "Strand", "ThickStart", "ThickEnd", "ItemRgb", "Valid Coverage", "Percent Modified"),
    "bedgraph": ("Chrom", "ChromStart", "ChromEnd", "DataValue"),
}
#: Formats by file extension.
FORMATS: dict[str, LineFormat] = {name: LineFormat(columns) for name, columns in COLUMNS.items()}


def register_format(extension: str, form: LineFormat) -> None:
    """Let ``read_track`` and the streams read files of a further extension."""
    if len(form.columns) < 4:
        raise InvalidInput("a track has at least four columns")
    FORMATS[extension] = form


#: What numbers look like.
UNSIGNED = r"^\+?[0-9]+$"
FLOAT = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


def split_fields(line: Column) -> Column:
    """Fields of a line, parted by any white space; none for a blank line."""
    trimmed = F.regexp_replace(F.coalesce(line, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def _row(fields: Column, names: tuple[str, ...]) -> Column:
    """struct(chrom, start, end, value, problem) of a line's fields, each of which is read once."""
    last = len(names) - 1

    def number(i: int) -> Column:
        return F.when(F.get(fields, F.lit(i)).rlike(UNSIGNED), F.get(fields, F.lit(i)).try_cast("long"))

    text = F.get(fields, F.lit(last))
    value = F.when(text.rlike(FLOAT), F.regexp_replace(text, r"^\+", "").try_cast("float"))

    def told(p: Column) -> Column:
        parsed = {1: p["start"], 2: p["end"], last: p["value"]}
        problem = F.lit(None).cast("string")
        for i in reversed(range(len(names))):
            if i in parsed:
                problem = F.when(parsed[i].isNull(), F.lit(f"invalid {names[i]} value")).otherwise(problem)
            problem = F.when(F.size(fields) <= i, F.lit(f"missing {names[i]} column")).otherwise(problem)
        return F.struct(F.get(fields, F.lit(0)).alias("chrom"), p["start"].alias("start"), p["end"].alias("end"), p["value"].alias("value"), problem.alias("problem"))

    parts = F.struct(number(1).alias("start"), number(2).alias("end"), value.alias("value"))
    return F.get(F.transform(F.array(parts), told), F.lit(0))


def parse_lines(lines: DataFrame, fmt: str, chrom: str | None = None, line_col: str = "line") -> DataFrame:
    """(line_no, chrom, start, end, value, problem): problem is null for good rows and names the first bad column else.

    With ``chrom``, rows of other chromosomes are dropped before anything else of them is looked at.  The row is made by
    a generator over one array of fields, which no later projection or filter is merged with, so a line is split once.
    """
    names = FORMATS[fmt].columns
    fields = F.array(split_fields(F.col(line_col)))
    if chrom is not None:
        fields = F.filter(fields, lambda f: (F.size(f) == 0) | (F.get(f, F.lit(0)) == chrom))
    return lines.select("line_no", F.inline(F.transform(fields, lambda f: _row(f, names))))


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("problem IS NULL").drop("problem")


def read_track(spark: SparkSession, path: str, chrom: str | None = None, fmt: str | None = None) -> DataFrame:
    """Rows of a track file (or of a folder's files, given their format); the first malformed line raises."""
    parsed = parse_lines(read_lines(spark, path), fmt or check_extension(path, FORMATS), chrom)
    bad = parsed.where("problem IS NOT NULL").orderBy("line_no").limit(1).collect()
    if bad:
        raise MalformedInput(bad[0]["problem"])
    return good_rows(parsed)
