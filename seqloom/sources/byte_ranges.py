"""Byte ranges of text files: where each line of a file begins, and reading ranges without the rest of their files.

Offsets come from one pass over the lines with Spark's text reader.  Ranges are rows of a DataFrame; tasks read them from
the store itself, through pyarrow's file systems (local paths, S3, HDFS, ...), so a region of a large file costs its own bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from seqloom.plans.ship import ship_package

#: Bytes that a task reads at once.
CHUNK = 4 << 20


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(split, line_no, value) of a file's lines or those of a folder's files, in order of their names; only line feeds part
    lines.  split is a struct (file, start)."""
    lines = spark.read.option("lineSep", "\n").text(path)
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return lines.select(split.alias("split"), F.monotonically_increasing_id().alias("line_no"), "value")


def running(lines: DataFrame, amount: Column, name: str, inclusive: bool, within: Column | None = None) -> DataFrame:
    """``lines`` with the running sum of ``amount`` in their order, each split summed in a task of its own; with ``within``, a
    function of the split (column _split), sums begin anew with each of its values."""
    rows = lines.withColumn("_amount", amount.cast("long"))
    inside = Window.partitionBy("split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    across = (Window.partitionBy(within) if within is not None else Window).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col("split").alias("_split")).agg(F.sum("_amount").alias("_sum")).select("_split", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0))).join(sums, F.col("split") == F.col("_split"))
    return rows.withColumn(name, F.col("_base") + F.col("_inside")).drop("_amount", "_split", "_base", "_inside")


def placed(lines: DataFrame) -> DataFrame:
    """Raw lines with ``at``, the byte at which each begins in its file, and ``bytes``, with its line feed."""
    sized = lines.withColumn("bytes", (F.octet_length("value") + 1).cast("long"))
    return running(sized, F.col("bytes"), "at", False, F.col("_split.file"))


def stamps(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, modified) of a path's files, by which an index knows whether they are still those it was made of."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def same_files(spark: SparkSession, path: str, kept: DataFrame) -> bool:
    """Whether the files of ``path`` have the stamps of ``kept``."""
    try:
        now = stamps(spark, path)
    except AnalysisException:
        return False
    return now.exceptAll(kept).isEmpty() and kept.exceptAll(now).isEmpty()


def opened(file: str) -> pa.NativeFile:
    """A file given by URI, to be read at any place."""
    system, where = pa.fs.FileSystem.from_uri(file)
    return system.open_input_file(where)


def readable(file: str) -> bool:
    """Whether pyarrow opens a file, given by URI."""
    try:
        opened(file).close()
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def _read(ranges: pa.RecordBatch) -> Iterator[bytes]:
    """The bytes of (file, start, stop) in the order of rows; a file stays open while rows are of it."""
    name, handle = None, None
    for file, start, stop in zip(*(ranges.column(i).to_pylist() for i in range(3)), strict=True):
        if file != name:
            name, handle = file, opened(file)
        yield handle.read_at(stop - start, start)


def spread(ranges: DataFrame) -> DataFrame:
    """Ranges (a few bytes each) dealt over as many tasks as shuffles have."""
    return ranges.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "start")


def read_ranges(ranges: DataFrame, drop: bytes = b"") -> DataFrame:
    """``ranges`` (file, start, stop, ...) with ``raw``, their bytes but for those in ``drop``; each range is to be of about CHUNK bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(_read(batch)):
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([raw.translate(None, drop) if drop else raw])], names=[*row.schema.names, "raw"])

    ship_package(ranges.sparkSession)
    columns = ranges.select("file", "start", "stop", *[c for c in ranges.columns if c not in ("file", "start", "stop")])
    return columns.mapInArrow(run, StructType([*columns.schema.fields, StructField("raw", BinaryType())]))


def lines_of_ranges(ranges: DataFrame) -> DataFrame:
    """(file, at, line) of ranges (file, start, stop) that begin and end with lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(_read(batch)):
                lines = raw.removesuffix(b"\n").split(b"\n")
                at, starts = batch.column(1)[i].as_py(), []
                for line in lines:
                    starts.append(at)
                    at += len(line) + 1
                file = pa.array([batch.column(0)[i].as_py()] * len(lines))
                yield pa.RecordBatch.from_arrays([file, pa.array(starts, pa.int64()), pa.array([x.removesuffix(b"\r").decode() for x in lines])], names=["file", "at", "line"])

    ship_package(ranges.sparkSession)
    return ranges.select("file", "start", "stop").mapInArrow(run, "file string, at long, line string")
