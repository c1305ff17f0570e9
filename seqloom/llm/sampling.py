"""Bounded samples that reach the driver in bounded size, whatever the number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def _share(digest: Column) -> Column:
    """First 32 bits of a hex digest, as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def smallest(rows: DataFrame, digest: Column, n: int, known: int, order: list[str], then=lambda df: df) -> list[Row]:
    """The ``n`` rows of the smallest digests.

    ``known`` is a number of rows (more is harmless): only digests below about 3 n / known are looked at first, so that
    partitions don't each send n rows to be merged; the bound is raised until n rows lie below it or it covers all.
    ``then`` is applied to the rows looked at, so that costly columns are made for those only.
    """
    bound = min(1.0, 3 * n / max(1, known))
    while True:
        found = then(rows.where(_share(digest) < bound) if bound < 1 else rows).orderBy(digest, *order).limit(n).collect()
        if len(found) >= n or bound >= 1:
            return found
        bound = min(1.0, bound * 8)
