"""The colour scale of methylation cells, as column functions: gamma-correct blends between three stops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base colours of the stops, how far they are lightened, and the fractions they stand at.
BASE_COLOURS = [(4, 55, 242), (127, 0, 255), (255, 0, 0)]
LIGHTER = 0.5
FRACTIONS = [0.0, 0.3, 0.5]

STOPS = [tuple(int(c + (255 - c) * LIGHTER) for c in colour) for colour in BASE_COLOURS]


def _to_linear(c: int) -> float:
    s = c / 255.0
    return s / 12.92 if s <= 0.04045 else ((s + 0.055) / 1.055) ** 2.4


def _to_byte(linear: Column) -> Column:
    s = F.when(linear <= 0.0031308, linear * 12.92).otherwise(F.pow(linear, F.lit(1.0 / 2.4)) * 1.055 - 0.055)
    return F.least(F.greatest(F.round(s * 255.0), F.lit(0.0)), F.lit(255.0)).cast("int")


def colour(percent: Column) -> Column:
    """struct(r, g, b) of a percentage."""
    v = F.least(F.greatest(percent.cast("double") / 100.0, F.lit(0.0)), F.lit(1.0))
    channels = []
    for k, name in enumerate("rgb"):
        value = F.lit(STOPS[-1][k])
        for i in reversed(range(len(STOPS) - 1)):
            a, b = _to_linear(STOPS[i][k]), _to_linear(STOPS[i + 1][k])
            t = (v - FRACTIONS[i]) / (FRACTIONS[i + 1] - FRACTIONS[i])
            value = F.when(v <= FRACTIONS[i + 1], _to_byte(t * (b - a) + a)).otherwise(value)
        channels.append(value.cast("int").alias(name))
    return F.struct(*channels)
