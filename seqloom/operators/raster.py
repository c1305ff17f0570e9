"""Sparse rasters: pixels (x, y, r, g, b), absent ones being white.

Dots grow within tiles of TILE x TILE pixels: a pixel goes to its own tile, and to those to the left and above only if it
lies so near their border that it reaches them, and each tile is painted in one pass over arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.plans.ship import ship_package

BLACK = (0, 0, 0)
TILE = 256


def _tiles(pixels: DataFrame, radius: int, tile: int, paint: Callable[[int, int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``paint`` (left, top, pixels) to the pixels that reach each tile; it gives those of the tile."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        return paint(key[0].as_py() * tile, key[1].as_py() * tile, table)

    def reached(at: str) -> Column:
        first = F.greatest(F.floor((F.col(at) - radius) / tile), F.lit(0))
        return F.explode(F.sequence(first, F.floor(F.col(at) / tile)))

    ship_package(pixels.sparkSession)
    wide = pixels.select("*", reached("x").alias("_tx")).select("*", reached("y").alias("_ty"))
    return wide.groupBy("_tx", "_ty").applyInArrow(one, schema)


def _grid(table: pa.Table, left: int, top: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, which are there) of a tile with its border to the right and below."""
    x, y = (table.column(c).to_numpy() - at for c, at in (("x", left), ("y", top)))
    there = np.zeros((size, size), bool)
    there[y, x] = True
    return y, x, there


def _placed(there: np.ndarray, left: int, top: int) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    y, x = np.nonzero(there)
    return y, x, [pa.array(x + left, pa.int64()), pa.array(y + top, pa.int64())]


def dilate_black(points: DataFrame, dot_size: int, tile: int = TILE) -> DataFrame:
    """(x, y): every dot also covers the dot_size columns left of it and rows above; sizes up to 1 add nothing."""
    if dot_size <= 1:
        return points.select("x", "y")
    tile = max(tile, dot_size)

    def paint(left: int, top: int, table: pa.Table) -> pa.Table:
        _, _, there = _grid(table, left, top, tile + dot_size)
        wide = np.logical_or.reduce([there[:, d : d + tile] for d in range(dot_size + 1)])
        grown = np.logical_or.reduce([wide[d : d + tile] for d in range(dot_size + 1)])
        return pa.Table.from_arrays(_placed(grown, left, top)[2], names=["x", "y"])

    return _tiles(points.select("x", "y"), dot_size, tile, paint, "x long, y long")


def dilate_colour(pixels: DataFrame, dot_size: int, tile: int = TILE) -> DataFrame:
    """Coloured dots grow up and to the left; a pixel reached by several averages them in raster order, rounding down."""
    if dot_size <= 1:
        return pixels
    tile = max(tile, dot_size)

    def paint(left: int, top: int, table: pa.Table) -> pa.Table:
        y, x, there = _grid(table, left, top, tile + dot_size)
        colours = np.zeros((*there.shape, 3), np.int32)
        colours[y, x] = np.stack([table.column(c).to_numpy() for c in "rgb"], axis=1)
        mixed, known = np.zeros((tile, tile, 3), np.int32), np.zeros((tile, tile), bool)
        for dy in range(dot_size + 1):
            for dx in range(dot_size + 1):
                here = there[dy : dy + tile, dx : dx + tile]
                own = colours[dy : dy + tile, dx : dx + tile][here]
                mixed[here] = np.where(known[here][:, None], (mixed[here] + own) >> 1, own)
                known |= here
        y, x, at = _placed(known, left, top)
        return pa.Table.from_arrays([*at, *(pa.array(mixed[y, x, i], pa.int32()) for i in range(3))], names=["x", "y", "r", "g", "b"])

    return _tiles(pixels.select("x", "y", "r", "g", "b"), dot_size, tile, paint, "x long, y long, r int, g int, b int")


def composite(coloured: DataFrame, black: DataFrame) -> DataFrame:
    """Black dots over coloured ones."""
    dots = black.select("x", "y", *[F.lit(v).alias(c) for c, v in zip("rgb", BLACK, strict=True)])
    under = coloured.join(black.select("x", "y"), ["x", "y"], "left_anti")
    return under.select("x", "y", "r", "g", "b").unionByName(dots)


def enlarge(pixels: DataFrame, w: int, h: int, side: int) -> tuple[DataFrame, int, int]:
    """Stretch a raster that is smaller than ``side`` both ways; the nearest source pixel counts."""
    if w >= side or h >= side:
        return pixels, w, h
    new_w, new_h = (int(side / h * w), side) if w < h else (side, int(side / w * h))

    def targets(at: str, old: int, new: int) -> Column:
        # outputs o with floor((o + 0.5) * old / new) = at
        lo, hi = F.ceil(F.col(at) * new / old - 0.5), F.ceil((F.col(at) + 1) * new / old - 0.5) - 1
        return F.when(hi >= lo, F.sequence(lo, F.least(hi, F.lit(new - 1)))).otherwise(F.array().cast("array<bigint>"))

    wide = pixels.select("r", "g", "b", "y", F.explode(targets("x", w, new_w)).alias("x"))
    return wide.select("x", F.explode(targets("y", h, new_h)).alias("y"), "r", "g", "b"), new_w, new_h


def scanlines(pixels: DataFrame) -> DataFrame:
    """(y, dots): the pixels of each row in order of x, as (x, r, g, b); a row is as wide as the plot at most."""
    dot = F.struct(*[F.col(c).cast("int").alias(c) for c in ("x", "r", "g", "b")])
    return pixels.groupBy("y").agg(F.array_sort(F.collect_list(dot)).alias("dots"))
