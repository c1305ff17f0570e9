"""Tracks that arrive as a stream of files: in each micro-batch the last line of a position wins, and later batches win
over earlier ones, so a sink that upserts by position holds the track without any streaming state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.errors import MalformedInput
from seqloom.operators.methylation import last_wins
from seqloom.sources.track import good_rows, parse_lines


def batch_rows(lines: DataFrame, fmt: str) -> DataFrame:
    """Parsed rows of a batch of lines (line, at, file, split), numbered by arrival, file and place in the file."""
    order = F.struct("at", "file", "split", F.monotonically_increasing_id().alias("n"))
    return parse_lines(lines.withColumn("line_no", order), fmt)


def batch_sites(parsed: DataFrame) -> DataFrame:
    """(chrom, start, pct) of the good rows of a batch."""
    return last_wins(good_rows(parsed), "chrom", "start")


def batch_problems(parsed: DataFrame) -> DataFrame:
    """(file, line_no, problem) of the malformed lines of a batch."""
    return parsed.where("problem IS NOT NULL").select("line_no.file", "line_no", "problem")


def start(
    spark: SparkSession, folder: str, fmt: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None], on_problems: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Read all files that are new in ``folder`` and call ``on_batch`` with the positions that each micro-batch sets;
    a restart goes on from the checkpoint.  Malformed lines go to ``on_problems``; without it the first one ends the
    query, as it would end the reading of a file."""
    lines = spark.readStream.schema("value string").text(folder).select(
        F.regexp_replace("value", "\r$", "").alias("line"),
        F.col("_metadata.file_modification_time").alias("at"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
    )

    def each(batch: DataFrame, epoch: int) -> None:
        parsed = batch_rows(batch, fmt)
        problems = batch_problems(parsed)
        if on_problems is not None:
            on_problems(problems, epoch)
        else:
            first = problems.orderBy("line_no").limit(1).collect()
            if first:
                raise MalformedInput(f"{first[0]['file']}: {first[0]['problem']}")
        on_batch(batch_sites(parsed), epoch)

    query = lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return query.foreachBatch(each).start()
