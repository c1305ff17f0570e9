"""Maximal matches: runs of k-mer matches along diagonals.

Matches (x, y), (x + 1, y + 1), ... of a run are one exact match of k + n - 1 bases that can't be grown on either
side.  Runs are gaps and islands over x within each diagonal x - y and band of x, so no window holds more than BAND
matches; runs that touch a band's border are then put together, a row for each band and diagonal at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAND = 4096


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, lo, hi) with those whose lo follows another's hi made one; none overlap."""
    order = Window.partitionBy(*keys).orderBy("lo")
    begins = F.coalesce(F.col("lo") - F.lag("hi").over(order) != 1, F.lit(True)).cast("int")
    numbered = rows.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order))
    return numbered.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def maximal_matches(pairs: DataFrame, k: int, band: int = BAND) -> DataFrame:
    """(x, y, length) of the maximal exact matches of at least k bases, from all matches (x, y, ...) of words of k bases."""
    placed = pairs.select((F.col("x") - F.col("y")).alias("d"), F.floor(F.col("x") / band).alias("band"), F.col("x").alias("lo"), F.col("x").alias("hi"))
    parts = _islands(placed, ["d", "band"])
    border = (F.col("lo") % band == 0) | (F.col("hi") % band == band - 1)
    whole = parts.where(~border).select("d", "lo", "hi").unionByName(_islands(parts.where(border).select("d", "lo", "hi"), ["d"]))
    return whole.select(F.col("lo").alias("x"), (F.col("lo") - F.col("d")).alias("y"), (F.col("hi") - F.col("lo") + k).alias("length"))


def words_of_matches(matches: DataFrame, k: int) -> DataFrame:
    """(x, y) of the words of maximal matches: what ``maximal_matches`` was made of."""
    each = matches.select("x", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - k)).alias("i"))
    return each.select((F.col("x") + F.col("i")).alias("x"), (F.col("y") + F.col("i")).alias("y"))
