"""The functions of this folder for SQL: temporary functions whose bodies are SQL, so the optimizer sees through them.

    register(spark)
    spark.sql("SELECT id, parse_region(text).start, k.pos, k.kmer FROM records, LATERAL kmers(seq, 21) AS k")

They are a session's own and need no worker.  ``kmers`` and ``fasta_lines`` are table functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from seqloom.functions.bases import LETTERS, PARTNERS
from seqloom.functions.color import FRACTIONS, STOPS, _to_linear

REGION = "STRUCT<kind: STRING, id: STRING, start: BIGINT, end: BIGINT>"


def _channel(k: int) -> str:
    """A channel of the colour scale at the fraction ``f``."""
    cases = []
    for i in range(len(STOPS) - 1):
        a, b = _to_linear(STOPS[i][k]), _to_linear(STOPS[i + 1][k])
        cases.append(f"WHEN f <= {FRACTIONS[i + 1]}D THEN linear_to_byte((f - {FRACTIONS[i]}D) / ({FRACTIONS[i + 1]}D - {FRACTIONS[i]}D) * ({b!r}D - {a!r}D) + {a!r}D)")
    return f"CASE {' '.join(cases)} ELSE {STOPS[-1][k]} END"


def _duration(power: int, unit: str) -> str:
    whole, rest = f"format_number(ns div {10**power}, 0)", f"(ns div {10 ** max(0, power - 3)}) % 1000"
    digits = f"substring(regexp_replace(lpad(CAST({rest} AS STRING), 3, '0'), '0+$', ''), 1, 2)"
    return f"concat({whole}, {f"CASE WHEN {rest} != 0 THEN concat('.', {digits}) ELSE '' END, " if power else ''}' {unit}')"


#: Name and arguments, result, body; in an order in which each uses earlier ones only.
FUNCTIONS: list[tuple[str, str, str]] = [
    ("reverse_complement(s STRING)", "STRING", f"reverse(translate(s, '{LETTERS}', '{PARTNERS}'))"),
    ("is_dna(s STRING)", "BOOLEAN", "s RLIKE '^[ACGTNacgtn]*$'"),
    ("first_offender(s STRING)", "STRING", "regexp_extract(s, '([^ACGTNacgtn])', 1)"),
    ("header_id(line STRING)", "STRING", r"regexp_extract(line, r'^>\s*(\S+)', 1)"),
    ("region_head(t STRING)", "STRING", "regexp_extract(t, '(?s)^(.*):[^:]*$', 1)"),
    ("region_span(t STRING)", "STRING", "CASE WHEN contains(t, ':') THEN regexp_extract(t, '(?s)^.*:([^:]*)$', 1) ELSE t END"),
    ("span_start(s STRING)", "BIGINT", "try_cast(regexp_extract(s, '(?s)^(.*)-[^-]*$', 1) AS BIGINT)"),
    ("span_end(s STRING)", "BIGINT", "try_cast(regexp_extract(s, '(?s)^.*-([^-]*)$', 1) AS BIGINT)"),
    ("is_span(s STRING)", "BOOLEAN", r"coalesce(s RLIKE r'^\+?[0-9]+-\+?[0-9]+$' AND span_start(s) < span_end(s), false)"),
    (
        "region_kind(t STRING)", "STRING",
        "CASE WHEN is_span(region_span(t)) THEN CASE WHEN NOT contains(t, ':') THEN 'slice' WHEN region_head(t) != '' THEN 'id_slice' END "
        "WHEN CASE WHEN contains(t, ':') THEN region_head(t) ELSE t END != '' THEN 'id' END",
    ),
    (
        "parse_region(t STRING)", REGION,
        "CASE WHEN region_kind(t) IS NOT NULL THEN named_struct('kind', region_kind(t), 'id', CASE region_kind(t) WHEN 'id' THEN t WHEN 'id_slice' THEN region_head(t) END, "
        "'start', CASE WHEN region_kind(t) != 'id' THEN span_start(region_span(t)) END, 'end', CASE WHEN region_kind(t) != 'id' THEN span_end(region_span(t)) END) END",
    ),
    ("region_label(r " + REGION + ")", "STRING", "CASE r.kind WHEN 'id' THEN r.id WHEN 'slice' THEN concat_ws('-', format_number(r.start, 0), format_number(r.end, 0)) ELSE concat_ws(':', r.id, concat_ws('-', format_number(r.start, 0), format_number(r.end, 0))) END"),
    ("region_file_label(r " + REGION + ")", "STRING", "CASE r.kind WHEN 'id' THEN r.id WHEN 'slice' THEN concat_ws('-', r.start, r.end) ELSE concat_ws('_', r.id, concat_ws('-', r.start, r.end)) END"),
    ("axis_label(name STRING, turned BOOLEAN)", "STRING", "CASE WHEN turned THEN concat(name, ' (rev. comp.)') ELSE name END"),
    ("truncate_label(s STRING, n INT)", "STRING", "CASE WHEN length(s) <= n THEN s WHEN n > 3 THEN concat(substring(s, 1, n - 3), '...') ELSE substring(s, 1, n) END"),
    ("thousands(n BIGINT)", "STRING", "format_number(n, 0)"),
    ("duration_label(ns BIGINT)", "STRING", f"CASE WHEN ns < 1 THEN '< 1 ns' WHEN ns < 1000 THEN {_duration(0, 'ns')} WHEN ns < 1000000 THEN {_duration(3, 'μs')} WHEN ns < 1000000000 THEN {_duration(6, 'ms')} ELSE {_duration(9, 's')} END"),
    ("linear_to_byte(c DOUBLE)", "INT", f"CAST(least(greatest(round(CASE WHEN c <= 0.0031308D THEN c * 12.92D ELSE pow(c, {1.0 / 2.4!r}D) * 1.055D - 0.055D END * 255D), 0D), 255D) AS INT)"),
    ("colour_at(f DOUBLE)", "STRUCT<r: INT, g: INT, b: INT>", "named_struct(" + ", ".join(f"'{name}', {_channel(k)}" for k, name in enumerate("rgb")) + ")"),
    ("methylation_colour(pct DOUBLE)", "STRUCT<r: INT, g: INT, b: INT>", "colour_at(least(greatest(pct / 100D, 0D), 1D))"),
    ("kmers(s STRING, k INT)", "TABLE(pos BIGINT, kmer STRING)", "SELECT CAST(p.col AS BIGINT), substring(s, p.col + 1, k) FROM explode(CASE WHEN length(s) >= k THEN sequence(0, length(s) - k) ELSE CAST(array() AS ARRAY<INT>) END) AS p"),
    ("fasta_lines(s STRING, width INT)", "TABLE(line BIGINT, bases STRING)", "SELECT CAST(p.col AS BIGINT), substring(s, p.col * width + 1, width) FROM explode(CASE WHEN length(s) > 0 THEN sequence(0, CAST(ceil(length(s) / width) AS INT) - 1) ELSE CAST(array() AS ARRAY<INT>) END) AS p"),
]


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; doing so again replaces them."""
    for signature, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
