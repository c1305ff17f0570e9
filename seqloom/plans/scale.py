"""How many bases a tile of the plot holds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TileScale:
    """Bases per tile and tiles (which are pixels) per axis."""

    tile_w: int
    tile_h: int
    out_w: int
    out_h: int

    @classmethod
    def fit(cls, max_side: int, w: int, h: int) -> TileScale:
        """The longer axis gets ``max_side`` tiles at most; short sequences are drawn one base a tile."""
        out_w, out_h = w, h
        if max(w, h) >= max_side:
            if w >= h:
                out_w, out_h = max_side, math.ceil(h * max_side / w)
            else:
                out_w, out_h = math.ceil(w * max_side / h), max_side
        tile_w, tile_h = math.ceil(w / out_w), math.ceil(h / out_h)
        return cls(tile_w, tile_h, max(1, -(-w // tile_w)), max(1, -(-h // tile_h)))


def scale_columns(side: Column, w: Column, h: Column) -> dict[str, Column]:
    """``TileScale.fit`` as columns."""
    big = F.greatest(w, h) >= side
    out_w = F.when(big, F.when(w >= h, side).otherwise(F.ceil(w * side.cast("double") / h))).otherwise(w)
    out_h = F.when(big, F.when(w >= h, F.ceil(h * side.cast("double") / w)).otherwise(side)).otherwise(h)
    tile_w, tile_h = F.ceil(w.cast("double") / out_w), F.ceil(h.cast("double") / out_h)
    return {
        "tile_w": tile_w,
        "tile_h": tile_h,
        "out_w": F.greatest(F.lit(1), F.ceil(w.cast("double") / tile_w)),
        "out_h": F.greatest(F.lit(1), F.ceil(h.cast("double") / tile_h)),
    }
