"""Methylation tracks: from parsed rows to sites, tiles and coloured cells.

Rows are (line_no, chrom, start, end, value); sites are (pos, pct), pct being a FLOAT percentage.  The order of steps is
part of the meaning: which rows may raise an error, or tell fractions from percentages, depends on the kind of region.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.errors import InvalidInput, MethylationError
from seqloom.functions.color import colour
from seqloom.operators.sequence import bases_at
from seqloom.plans.durable import materialise
from seqloom.plans.region import Region
from seqloom.plans.scale import TileScale


def single_base(rows: DataFrame) -> Column:
    """Whether a row is one base long."""
    return F.col("end") == F.col("start") + 1


def wide_rows(rows: DataFrame) -> DataFrame:
    """Rows that aren't one base long."""
    return rows.where(~single_base(rows))


def value_range(rows: DataFrame) -> DataFrame:
    """One row (lo, hi, n): the least and greatest value, NaN left out, and the number of rows."""
    real = F.when(~F.isnan("value"), F.col("value"))
    return rows.agg(F.min(real).alias("lo"), F.max(real).alias("hi"), F.count("*").alias("n"))


def scale_verdict(lo: Column, hi: Column, n: Column) -> Column:
    """fraction, percent, none (no rows) or error."""
    return (
        F.when(n == 0, F.lit("none")).when((lo >= 0) & (hi <= 1), F.lit("fraction")).when((lo >= 0) & (hi <= 100), F.lit("percent")).otherwise(F.lit("error"))
    )


def last_wins(rows: DataFrame, *keys: str) -> DataFrame:
    """The value of the last line for each key."""
    return rows.groupBy(*keys).agg(F.max_by("value", "line_no").alias("pct"))


@dataclass(frozen=True)
class Stages:
    """What a region makes of a track: ``checked`` rows are validated and tell the scale, ``sites`` become positions."""

    checked: DataFrame
    sites: DataFrame


def track_stages(rows: DataFrame, contigs: DataFrame, region: Region | None) -> Stages:
    """Split a track by its region; ``contigs`` has (ord, id, n, off).

    * none: every row is checked, also of unknown chromosomes; the first contig of a name takes its sites, and where sites
      of several contigs meet (they may lie past a contig's end) the last contig's stays, by offset and then by ord, as
      contigs without bases share their offset with the next;
    * id: only the chromosome's rows are checked;
    * id and interval: rows in the interval, then of the chromosome, counted from the interval's start;
    * interval: rows of known chromosomes (the last contig of a name) that lie in the interval of the whole.
    Positions are not checked against the end of a contig.
    """
    if region is None:
        first = contigs.groupBy("id").agg(F.min_by(F.struct("off", "ord"), F.struct(F.col("ord").isNull(), "ord")).alias("_at"))
        deduped = last_wins(rows.join(first.select(F.col("id").alias("chrom")), "chrom", "left_semi"), "chrom", "start")
        placed = deduped.join(first.withColumnRenamed("id", "chrom"), "chrom")
        last = F.max_by("pct", F.struct("_at.off", F.col("_at.ord").isNull(), "_at.ord", "chrom")).alias("pct")
        return Stages(rows, placed.select((F.col("_at.off") + F.col("start")).alias("pos"), "pct", "_at", "chrom").groupBy("pos").agg(last))
    if region.kind == "slice":
        last = contigs.groupBy("id").agg(F.max_by("off", "ord").alias("_off")).withColumnRenamed("id", "chrom")
        at = rows.join(last, "chrom").withColumn("pos", F.col("_off") + F.col("start")).where((F.col("pos") >= region.start) & (F.col("pos") < region.end))
        return Stages(at.select(*rows.columns), last_wins(at.withColumn("pos", F.col("pos") - region.start), "pos"))
    own = rows.where(F.col("chrom") == region.id)
    base = 0
    if region.kind == "id_slice":
        own, base = own.where((F.col("start") >= region.start) & (F.col("start") < region.end)), region.start
    return Stages(own, last_wins(own.withColumn("pos", F.col("start") - base), "pos"))


def to_percent(sites: DataFrame, verdict: str) -> DataFrame:
    """Fractions times 100 in single precision."""
    return sites.withColumn("pct", F.col("pct") * F.lit(100.0).cast("float")) if verdict == "fraction" else sites


def above(sites: DataFrame, threshold: float) -> DataFrame:
    """Sites of at least ``threshold`` percent; NaN is never."""
    return sites.where((F.col("pct") >= F.lit(threshold).cast("float")) & ~F.isnan("pct"))


def on_cytosine(sites: DataFrame, pieces: DataFrame) -> DataFrame:
    return bases_at(sites, pieces).where(F.col("base") == "C").drop("base")


def mismatches(sites: DataFrame, pieces: DataFrame) -> DataFrame:
    """Sites that aren't on a C, also those past the end."""
    return bases_at(sites, pieces).where(F.col("base").isNull() | (F.col("base") != "C"))


def mirrored(sites: DataFrame, length: int) -> DataFrame:
    return sites.withColumn("pos", F.lit(length - 1) - F.col("pos"))


def read_sites(rows: DataFrame, contigs: DataFrame, region: Region | None, threshold: float = 0.0, allow_wide: bool = False) -> DataFrame | None:
    """Sites of a track with its checks; None where a region has none."""
    stages = track_stages(rows, contigs, region)
    if not allow_wide:
        bad = wide_rows(stages.checked).orderBy("line_no").limit(1).collect()
        if bad:
            raise MethylationError("interval", f"row {bad[0]['line_no']}: {bad[0]['start']}-{bad[0]['end']} is not one base long")
    stats = value_range(stages.checked).withColumn("verdict", scale_verdict(F.col("lo"), F.col("hi"), F.col("n"))).first()
    if stats["verdict"] == "error":
        raise MethylationError("scale", f"values from {stats['lo']} to {stats['hi']} are neither fractions nor percentages")
    if region is not None and stats["n"] == 0:
        return None
    return above(to_percent(stages.sites, stats["verdict"]), threshold)


def removed_count(sites: DataFrame, pieces: DataFrame) -> int:
    """How many sites pruning takes away."""
    return mismatches(sites, pieces).count()


def pruned(sites: DataFrame, pieces: DataFrame) -> tuple[DataFrame, int]:
    """Sites on a C, and how many weren't; sites and bases are joined once, and written."""
    marked = materialise(bases_at(sites, pieces), "marked-sites")
    on_c = F.coalesce(F.col("base") == "C", F.lit(False))
    return marked.where(on_c).drop("base"), marked.where(~on_c).count()


def settle_mismatches(sites: DataFrame, pieces: DataFrame, on_mismatch: str = "prune") -> DataFrame:
    """``prune`` drops sites that aren't on a C, ``error`` raises at the first of them."""
    if on_mismatch == "prune":
        return on_cytosine(sites, pieces)
    if on_mismatch != "error":
        raise InvalidInput("on_mismatch is prune or error")
    first = mismatches(sites, pieces).agg(F.min("pos")).first()[0]
    if first is not None:
        raise MethylationError("mismatch", f"position {first} is not a cytosine")
    return sites


def tile_stats(sites: DataFrame, tile: int, out: int) -> DataFrame:
    """(tile, c, s): sites and sum of percentages per tile of an axis."""
    placed = sites.withColumn("tile", F.call_function("div", F.col("pos"), F.lit(tile))).where(F.col("tile") < out)
    return placed.groupBy("tile").agg(F.count("*").alias("c"), F.sum(F.col("pct").cast("double")).alias("s"))


def cells(x_stats: DataFrame, y_stats: DataFrame, bands: int = 16) -> DataFrame:
    """(tx, ty, pct): every pair of tiles with sites, weighted by their counts.

    The pairs are the result; they are made by an equi-join on bands of the y tiles, so each task gets its share of the plot.
    """
    xs = x_stats.select(F.col("tile").alias("tx"), F.col("c").alias("c1"), F.col("s").alias("s1"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bands - 1).cast("long"))).alias("band"))
    ys = y_stats.select(F.col("tile").alias("ty"), F.col("c").alias("c2"), F.col("s").alias("s2"), (F.col("tile") % bands).alias("band"))
    return xs.join(ys, "band").select("tx", "ty", ((F.col("s1") + F.col("s2")) / (F.col("c1") + F.col("c2"))).cast("float").alias("pct"))


def coloured(cells_df: DataFrame) -> DataFrame:
    """(x, y, r, g, b)."""
    return cells_df.select(F.col("tx").alias("x"), F.col("ty").alias("y"), colour(F.col("pct")).alias("c")).select("x", "y", "c.r", "c.g", "c.b")


def meth_cells(x_sites: DataFrame, y_sites: DataFrame, scale: TileScale) -> DataFrame:
    return cells(tile_stats(x_sites, scale.tile_w, scale.out_w), tile_stats(y_sites, scale.tile_h, scale.out_h))
