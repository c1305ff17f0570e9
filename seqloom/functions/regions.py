"""The region grammar as column functions, for tables of region texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _last(text: Column, sep: str) -> tuple[Column, Column]:
    """What stands before and after the last ``sep``."""
    return F.regexp_extract(text, f"(?s)^(.*){sep}[^{sep}]*$", 1), F.regexp_extract(text, f"(?s)^.*{sep}([^{sep}]*)$", 1)


def parse_region(text: Column) -> Column:
    """struct(kind, id, start, end), null where the text names no region."""
    colon = F.contains(text, F.lit(":"))
    head, tail = _last(text, ":")
    span = F.when(colon, tail).otherwise(text)
    lo, hi = (part.try_cast("long") for part in _last(span, "-"))
    good = span.rlike(r"^\+?[0-9]+-\+?[0-9]+$") & lo.isNotNull() & hi.isNotNull() & (lo < hi)
    kind = (
        F.when(good & colon & (head != ""), F.lit("id_slice")).when(good & ~colon, F.lit("slice")).when(~good & (F.when(colon, head).otherwise(text) != ""), F.lit("id"))
    )
    name = F.when(kind == "id_slice", head).when(kind == "id", text)
    start, end = F.when(kind != "id", lo), F.when(kind != "id", hi)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), name.alias("id"), start.alias("start"), end.alias("end")))


def pretty(region: Column) -> Column:
    """Label with thousands separators."""
    span = F.concat_ws("-", F.format_number(region["start"], 0), F.format_number(region["end"], 0))
    return F.when(region["kind"] == "id", region["id"]).when(region["kind"] == "slice", span).otherwise(F.concat_ws(":", region["id"], span))


def file_label(region: Column) -> Column:
    span = F.concat_ws("-", region["start"].cast("string"), region["end"].cast("string"))
    return F.when(region["kind"] == "id", region["id"]).when(region["kind"] == "slice", span).otherwise(F.concat_ws("_", region["id"], span))
