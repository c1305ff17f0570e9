"""Keep a methylation track that arrives as files: the last value of each position, and tiles of each chromosome.

    python -m jobs.track_tiles --track DIR --out DIR --checkpoint DIR [--config FILE] [--master local[8]]

The job is a file stream.  Each run takes the files that no finished run has taken (``availableNow``; Spark's checkpoint
knows them) and ends.  Three tables under ``--out`` come of it, all partitioned:

* ``deltas`` (epoch, bucket): what each micro-batch sets, a row for each position.  A batch that is repeated after a
  crash has the same epoch and replaces its own rows.
* ``sites`` and ``tiles`` (bucket): the track as it stands, and its tiles.  After the stream has ended, those buckets of
  chromosomes that got new deltas are made anew from all deltas of the bucket, so nothing is read that is being
  overwritten; a table of marks says up to which epoch that has been done, and is written last.

The last line of a position wins, by the ``order`` of the lines and not by their arrival, so any grouping into files, batches
and runs gives the same tables.  Rows that aren't one base long, or lack a chromosome, position, value or
order, are counted by reason in ``rejects`` (epoch), and otherwise left out.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, load_config, overwrite_parts, read_if_there, session
from seqloom.errors import ConfigError
from seqloom.operators.methylation import above, single_base, to_percent

log = logging.getLogger("jobs.track_tiles")

DELTAS = "chrom string, start long, value float, line_no long, epoch long, bucket int"
SITES = "chrom string, pos long, pct float, bucket int"
TILES = "chrom string, tile long, sites long, pct_sum double, pct_mean double, bucket int"
REJECTS = "reason string, n long, epoch long"
MARKS = "settled long, sites long"


@dataclass(frozen=True)
class Config:
    """``chrom``, ``start``, ``end``, ``value`` and ``order`` are SQL expressions over the columns of the track's files."""

    chrom: str = "chrom"
    start: str = "start"
    end: str = "end"
    value: str = "value"
    order: str = "line_no"
    format: str = "parquet"
    values: str = "percent"
    tile: int = 50
    threshold: float = 0.0
    buckets: int = 16
    files_per_batch: int = 1000

    def checked(self) -> Config:
        if self.values not in ("percent", "fraction"):
            raise ConfigError("values is percent or fraction")
        if self.tile < 1 or self.buckets < 1 or self.files_per_batch < 1 or not 0 <= self.threshold <= 100:
            raise ConfigError("tile, buckets and files_per_batch are at least 1, threshold is 0 to 100")
        return self


def rows_of(batch: DataFrame, config: Config) -> DataFrame:
    """(line_no, chrom, start, end, value, reason): reason is null for good rows."""
    parts = {"line_no": (config.order, "long"), "chrom": (config.chrom, "string"), "start": (config.start, "long"), "end": (config.end, "long"), "value": (config.value, "float")}
    rows = batch.select(*[F.expr(said).cast(kind).alias(name) for name, (said, kind) in parts.items()])
    reason = F.lit(None).cast("string")
    for name in reversed(parts):
        reason = F.when(F.col(name).isNull(), F.lit(f"no {name}")).otherwise(reason)
    reason = F.coalesce(reason, F.when(F.col("start") < 0, F.lit("start below 0")), F.when(~single_base(rows), F.lit("not one base long")))
    return rows.withColumn("reason", reason)


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, value, line_no): each position's last line; of equal lines the largest value."""
    return rows.groupBy(*keys).agg(F.max(F.struct("line_no", "value")).alias("last")).select(*keys, "last.value", "last.line_no")


def take_batch(batch: DataFrame, epoch: int, out: str, config: Config) -> int:
    """Write what a micro-batch sets, return the number of its rows; the same batch again gives the same files' contents."""
    seen = Observation()
    rows = rows_of(batch, config)
    good = latest(rows.observe(seen, F.count(F.lit(1)).alias("n")).where("reason IS NULL"), "chrom", "start")
    bucket = F.pmod(F.xxhash64("chrom"), F.lit(config.buckets)).cast("int")
    overwrite_parts(good.withColumn("epoch", F.lit(epoch).cast("long")).withColumn("bucket", bucket), f"{out}/deltas", "epoch", "bucket")
    bad = rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    overwrite_parts(bad.withColumn("epoch", F.lit(epoch).cast("long")), f"{out}/rejects", "epoch")
    return seen.get["n"]


def settle(spark: SparkSession, out: str, config: Config) -> dict[str, int]:
    """Bring ``sites`` and ``tiles`` up to the last epoch of ``deltas``."""
    settled = read_if_there(spark, f"{out}/marks", MARKS).agg(F.max("settled")).first()[0]
    deltas = read_if_there(spark, f"{out}/deltas", DELTAS)
    fresh = deltas if settled is None else deltas.where(F.col("epoch") > settled)
    touched, last, n = fresh.agg(F.collect_set("bucket"), F.max("epoch"), F.count("*")).first()  # at most config.buckets
    told = {"new_positions": n, "buckets": len(touched), "sites": 0}
    if not n:
        return told
    kept = latest(deltas.where(F.col("bucket").isin(touched)), "bucket", "chrom", "start")
    kept = to_percent(kept.withColumnsRenamed({"start": "pos", "value": "pct"}), config.values)
    overwrite_parts(kept.select("chrom", "pos", "pct", "bucket"), f"{out}/sites", "bucket")
    now = read_if_there(spark, f"{out}/sites", SITES).where(F.col("bucket").isin(touched))
    shown = above(now, config.threshold).withColumn("tile", F.call_function("div", F.col("pos"), F.lit(config.tile)))
    tiles = shown.groupBy("bucket", "chrom", "tile").agg(F.count("*").alias("sites"), F.sum(F.col("pct").cast("double")).alias("pct_sum"))
    # a bucket all of whose sites are below the threshold now has no tiles: a marker row keeps its partition in the overwrite
    none = spark.createDataFrame([(b,) for b in touched], "bucket int").select("bucket", F.lit(None).cast("string").alias("chrom"), F.lit(None).cast("long").alias("tile"), F.lit(0).cast("long").alias("sites"), F.lit(0.0).alias("pct_sum"))
    every = tiles.unionByName(none).withColumn("pct_mean", F.col("pct_sum") / F.nullif("sites", F.lit(0)))
    overwrite_parts(every.select("chrom", "tile", "sites", "pct_sum", "pct_mean", "bucket"), f"{out}/tiles", "bucket")
    told["sites"] = now.count()
    overwrite_parts(spark.createDataFrame([(last, told["sites"])], MARKS), f"{out}/marks", "settled")
    return told


def tiles_of(spark: SparkSession, out: str) -> DataFrame:
    """(chrom, tile, sites, pct_sum, pct_mean) as they stand."""
    return read_if_there(spark, f"{out}/tiles", TILES).where("chrom IS NOT NULL").drop("bucket")


def run(spark: SparkSession, track: str, out: str, checkpoint: str, config: Config | None = None) -> dict[str, int]:
    """One run: take the new files of ``track`` (a folder, or one file), then settle; what was read and written."""
    config = (config or Config()).checked()
    schema = spark.read.format(config.format).load(track).schema
    at = track.rstrip("/")
    lines = spark.readStream.format(config.format).schema(schema).option("maxFilesPerTrigger", config.files_per_batch).load(f"{at[:-1]}[{at[-1]}]")  # a pattern of one name: the source takes no plain file
    taken: list[int] = []
    stream = lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = stream.foreachBatch(lambda batch, epoch: taken.append(take_batch(batch, epoch, out, config))).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("read %d new rows of %s in %d batches", sum(taken), track, len(taken))
    told = {"rows": sum(taken)} | settle(spark, out, config)
    for r in read_if_there(spark, f"{out}/rejects", REJECTS).groupBy("reason").agg(F.sum("n").alias("n")).collect():  # a row for each reason
        log.info("left out so far: %d rows, %s", r["n"], r["reason"])
    log.info("wrote %d sites in %d buckets of %s, %d positions were new", told["sites"], told["buckets"], out, told["new_positions"])
    return told


def main(argv: list[str] | None = None) -> None:
    given = command_line(__doc__.split("\n\n")[0], "track_tiles.json", ["track", "out", "checkpoint"], argv)
    config = load_config(Config, given.config)
    spark = session("track_tiles", given.master)
    try:
        run(spark, given.track, given.out, given.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
