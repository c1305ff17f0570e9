"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is built-in column functions.  Spans of a pattern come from two passes of the same expression: the
matches themselves and the gaps between them; running sums of their lengths are code-point offsets.  Proposals
are then validated (octet range, Luhn, digit counts, mod 97) and scored; a context word in the 48 characters
before a span raises the score.  The kinds email, ip, card and phone are always kept once valid, and a context word
counts for the first match behind it only; the added kinds (iban, ssn) are kept from ``min_score`` on, so an ssn
needs a context word, which counts for every match within the 48 characters, as in a list.  An iban that lies within an
earlier valid one is part of it.

No step costs more than the text and its spans: the patterns hold possessive quantifiers and, where a run could be
re-entered, look-behinds, so each is linear in the text; running sums and maxima over the spans of a text are made by
doubling steps over whole arrays; and text is taken out by way of blocks of BLOCK characters, never by counting
from its start.

Defined results for odd input: a null text counts as empty; empty text has no spans and the digest of the empty
string; whole texts are searched, whatever their length and number of spans; equal and null ids stay separate rows;
empty tables give empty results; other columns are not read and do not clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How far before a span context words count, in code points.
CONTEXT_CHARS = 48
#: Characters of the blocks by which parts of a text are reached.
BLOCK = 512
#: An iban's heads are five characters apart and its longest proposal has 64, so at most so many heads lie before one in a span.
HEADS = 13

#: Patterns (kind, what a text must contain at least, pattern).  The first four are the plain forms
#: of the contract with possessive quantifiers.  An iban's pattern takes its first four characters only and looks ahead
#: to the longest proposal, so that a search goes on behind each head.
PATTERNS = [
    ("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "[0-9]\\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "[0-9][ -]?[0-9]", r"[0-9](?:[\x20-]?+[0-9]){11,}+"),
    ("phone", "\\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])))"),
    ("ssn", "[0-9]-[0-9]{2}-[0-9]", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])"),
]
BASE_KINDS = ("email", "ip", "card", "phone")

#: Score without context and context words, by kind.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|address",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|social-security",
}
CONTEXT_BONUS = 0.3


def luhn_ok(digits: Column) -> Column:
    """Luhn's checksum over a string of digits."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """The mod-97 check: first four characters to the end, letters as 10 to 35, remainder 1."""
    packed = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(packed, F.lit(5)), F.substring(packed, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def longest_iban(proposal: Column) -> Column:
    """The longest beginning of ``proposal`` that ends with a word of it, has 15 characters at least and passes mod 97; null if none."""
    words = F.split(proposal, " ", -1)
    ends = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    return F.get(F.filter(ends, lambda e: (F.length(F.replace(e, F.lit(" "), F.lit(""))) >= 15) & mod97_ok(e)), F.lit(0))


def octets_ok(ip: Column) -> Column:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
    return ip.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _card_ok(hit: Column) -> Column:
    d = _digits(hit)
    return F.when(F.length(d).between(12, 19), luhn_ok(d)).otherwise(False)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda hit: F.lit(True),
    "ip": octets_ok,
    "card": _card_ok,
    "phone": lambda hit: F.length(_digits(hit)).between(9, 15),
    "iban": lambda hit: F.lit(True),  # longest_iban has tried it
    "ssn": lambda hit: ~hit.rlike("^(000|666|9)|-00-|-0000$"),
}

_SPAN = "struct<start:long,rank:int,end:long,kind:string,score:double>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running results of an associative ``join`` over an array of numbers from 0 on, 0 being neutral: the k-th
    step joins each value with the one 2**k places before it, so n values take n log n joins."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, k: Column) -> Column:
        shift = F.call_function("shiftleft", F.lit(1), k)
        return F.zip_with(acc, F.slice(F.concat(F.array_repeat(F.lit(0).cast("long"), shift), acc), F.lit(1), F.size(acc)), join)

    return F.aggregate(steps, values, step)


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part_of(blocks: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` to ``end`` (exclusive) of a text in blocks, at the cost of the blocks that hold them."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    held = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substr(held, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))


def _scored(kind: str, rank: int, found: Column, start: Column, before: Column) -> Column:
    near = F.lower(before).rlike(f"(?<![a-z])(?:{CONTEXT[kind]})")
    score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near, CONTEXT_BONUS).otherwise(0.0))
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(found)).alias("end"), F.lit(kind).alias("kind"), score.alias("score"))


def _spans_of(text: Column, blocks: Column, kind: str, rank: int, needs: str, pattern: str, min_score: float) -> Column:
    """array of valid spans of one kind, in order."""

    def all_of(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(p: Column) -> Column:
        """Every match with its start and the gap before it."""
        ends = running(F.zip_with(p["gaps"], p["hits"], lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("long")), lambda x, y: x + y)
        found = F.zip_with(p["hits"], p["rests"], lambda h, r: longest_iban(F.concat(h, r))) if kind == "iban" else p["hits"]
        rows = F.arrays_zip(F.slice(p["gaps"], F.lit(1), F.size(p["hits"])).alias("gap"), p["hits"].alias("hit"), found.alias("found"), F.slice(ends, F.lit(1), F.size(p["hits"])).alias("upto"))
        valid = F.filter(rows, lambda r: r["found"].isNotNull() & VALID[kind](r["found"]))
        return F.transform(valid, spanned)

    def spanned(r: Column) -> Column:
        start = r["upto"] - F.length(r["hit"])
        before = F.right(r["gap"], F.lit(CONTEXT_CHARS)) if kind in BASE_KINDS else part_of(blocks, F.greatest(start - CONTEXT_CHARS, F.lit(0).cast("long")), start)
        return _scored(kind, rank, r["found"], start, before)

    def outer(spans: Column) -> Column:
        """Without spans that lie within an earlier one."""
        def held(s: Column, i: Column) -> Column:
            earlier = F.slice(spans, F.greatest(i - HEADS, F.lit(0)) + 1, F.least(i, F.lit(HEADS)))
            return ~F.exists(earlier, lambda e: e["end"] >= s["end"])

        return F.filter(spans, held)

    parts = [F.split(text, pattern, -1).alias("gaps"), all_of(0).alias("hits")] + ([all_of(1).alias("rests")] if kind == "iban" else [])
    found = _let(F.struct(*parts), placed)
    if kind == "iban":
        found = _let(found, outer)
    if kind not in BASE_KINDS:
        found = F.filter(found, lambda s: s["score"] >= min_score)
    cheap = text.contains("@") if needs == "@" else text.rlike(needs)
    return F.when(cheap, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii_spans", min_score: float = 0.6) -> DataFrame:
    """``docs`` with a column of spans: array of (start, rank, end, kind, score), by start, then kind.

    Offsets are code points, end exclusive.  A column of the name ``out_col`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def every(blocks: Column) -> Column:
        parts = [_spans_of(text, blocks, kind, rank, needs, pattern, min_score) for rank, (kind, needs, pattern) in enumerate(PATTERNS)]
        return F.array_sort(F.concat(*parts))

    any_sign = text.rlike("[0-9@]")
    # only the added kinds read blocks, so texts without a sign of them have none
    needed = text.rlike("|".join(needs for kind, needs, _ in PATTERNS if kind not in BASE_KINDS))
    blocks = F.when(needed, blocks_of(text)).otherwise(F.array().cast("array<string>"))
    return docs.withColumn(out_col, F.when(any_sign, _let(blocks, every)).otherwise(F.array().cast(f"array<{_SPAN}>")))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans are joined under the first.

    ``spans`` is sorted by start, as ``find_pii`` gives it.
    """

    def bound(p: Column) -> Column:
        upto = running(F.transform(p["spans"], lambda s: s["end"]), lambda x, y: F.greatest(x, y))
        return _let(F.struct(p["blocks"].alias("blocks"), p["spans"].alias("spans"), F.concat(F.array(F.lit(0).cast("long")), upto).alias("begins")), pieces)

    def pieces(p: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            begin = F.get(p["begins"], i)
            return F.when(s["start"] >= begin, F.concat(part_of(p["blocks"], begin, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))

        rest = part_of(p["blocks"], F.element_at(p["begins"], -1), F.length(text).cast("long"))
        return F.concat(F.array_join(F.transform(p["spans"], piece), ""), rest)

    done = _let(F.struct(blocks_of(text).alias("blocks"), spans.alias("spans")), bound)
    return F.when(F.size(spans) > 0, done).otherwise(text)


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("pii_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    base = F.filter(spans, lambda s: s["rank"] < len(BASE_KINDS))
    return find_pii(docs).select("doc_id", *counts, F.sha2(span_string(base), 256).alias("base_sha256"), span_string(spans).alias("spans"))


def _sql() -> str:
    """The same in SQL: plain patterns, as there are neither possessive quantifiers nor look-arounds; the proposals of
    an iban are read from the text behind its head."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    parts = []
    for rank, (kind, pattern) in enumerate(plain.items()):
        parts.append(
            f"SELECT rid, t, {rank} AS rank, '{kind}' AS kind, {SCORES[kind]} AS base, '(^|[^a-z])({CONTEXT[kind]})' AS words, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m FROM d WHERE regexp_matches(t, '{pattern}')"
        )
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(reverse({digits}), k, 1) AS INTEGER) WHEN CAST(substr(reverse({digits}), k, 1) AS INTEGER) > 4 THEN 2 * CAST(substr(reverse({digits}), k, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(reverse({digits}), k, 1) AS INTEGER) END)) % 10 = 0"
    turned = "(substr(replace(e, ' ', ''), 5) || substr(replace(e, ' ', ''), 1, 4))"
    mod97 = f"list_reduce(list_prepend(0, list_transform(range(1, length({turned}) + 1), lambda k: CAST(ascii(substr({turned}, k, 1)) AS BIGINT))), lambda r, c: CASE WHEN c >= 65 THEN (r * 100 + c - 55) % 97 ELSE (r * 10 + c - 48) % 97 END) = 1"
    ends = "list_transform(range(len(string_split(proposal, ' ')), 0, -1), lambda n: array_to_string(string_split(proposal, ' ')[1:n], ' '))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
h AS ({' UNION ALL '.join(parts)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM h),
s AS (SELECT rid, t, rank, kind, base, words, g[i] AS gap, m[i] AS hit, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM i),
f AS (SELECT rid, rank, kind, base, words, CASE WHEN rank < 4 THEN right(gap, {CONTEXT_CHARS}) ELSE substr(t, CAST(greatest(a - {CONTEXT_CHARS}, 0) + 1 AS BIGINT), CAST(least(a, {CONTEXT_CHARS}) AS BIGINT)) END AS before, a, hit,
  CASE WHEN kind = 'iban' THEN regexp_extract(substr(t, CAST(a + 1 AS BIGINT), 65), '^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}\\b') ELSE '' END AS proposal FROM s),
n AS (SELECT rid, rank, kind, base, words, before, a, CASE WHEN kind = 'iban' THEN list_filter({ends}, lambda e: length(replace(e, ' ', '')) >= 15 AND {mod97})[1] ELSE hit END AS hit FROM f WHERE kind <> 'iban' OR proposal <> ''),
w AS (SELECT rid, rank, kind, base, words, before, CAST(a AS BIGINT) AS a, CAST(a + length(hit) AS BIGINT) AS b FROM n WHERE
  CASE kind WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0
  WHEN 'card' THEN CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn} ELSE false END
  WHEN 'phone' THEN length({digits}) BETWEEN 9 AND 15
  WHEN 'iban' THEN hit IS NOT NULL
  WHEN 'ssn' THEN NOT regexp_matches(hit, '^(000|666|9)|-00-|-0000$') ELSE true END),
x AS (SELECT *, max(b) OVER (PARTITION BY rid, kind ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM w),
v AS (SELECT rid, rank, kind, a, b FROM x WHERE (kind <> 'iban' OR earlier IS NULL OR earlier < b)
  AND (rank < 4 OR least(1.0, base + CASE WHEN regexp_matches(lower(before), words) THEN {CONTEXT_BONUS} ELSE 0.0 END) >= 0.6)),
o AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM v GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip, CAST(coalesce(n_card, 0) AS BIGINT) AS n_card, CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (rid)
"""


OP2_SQL = _sql()
