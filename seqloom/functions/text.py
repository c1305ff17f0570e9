"""Column functions for labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def truncate(text: Column, max_len: int, count_ellipsis: bool = True) -> Column:
    """At most ``max_len`` characters; where more than three fit, three dots mark what was cut."""
    dots = max_len > 3
    kept = F.substring(text, 1, max_len - 3 if dots and count_ellipsis else max_len)
    return F.when(F.length(text) <= max_len, text).otherwise(F.concat(kept, F.lit("...")) if dots else kept)


def axis_label(name: Column, turned: Column) -> Column:
    """What an axis is called; the reverse complement is marked."""
    return F.when(turned, F.concat(name, F.lit(" (rev. comp.)"))).otherwise(name)


def duration(ns: Column) -> Column:
    """A BIGINT of nanoseconds in the largest unit up to seconds, with up to two decimals, cut off."""

    def shown(power: int, unit: str) -> Column:
        whole = F.floor(ns / F.lit(10**power)) if power == 0 else F.call_function("div", ns, F.lit(10**power))
        rest = F.call_function("div", ns, F.lit(10 ** (power - 3))) % 1000 if power else F.lit(0).cast("long")
        digits = F.substring(F.regexp_replace(F.lpad(rest.cast("string"), 3, "0"), "0+$", ""), 1, 2)
        return F.concat(F.format_number(whole, 0), F.when(rest != 0, F.concat(F.lit("."), digits)).otherwise(F.lit("")), F.lit(f" {unit}"))

    chosen = F.when(ns < 1, F.lit("< 1 ns"))
    for power, unit in ((0, "ns"), (3, "μs"), (6, "ms")):
        chosen = chosen.when(ns < 10 ** (power + 3), shown(power, unit))
    return chosen.otherwise(shown(9, "s"))
