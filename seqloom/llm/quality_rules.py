"""Quality rules as a bitmask ledger.

Every text is measured once and every rule is evaluated once; the ledger keeps the measurements and one bit per failed
rule.  Policies are versioned sets of rules, that is masks: a document passes a policy if ledger and mask share no
bit, so a new policy or an ablation (what would one rule less keep?) is bit arithmetic over the ledger and never reads
a text again.  ``write_ledger`` stores the ledger as a table; the registered queries write it once and read all
policies and ablations from it.

Words are runs of anything but space and U+0009 to U+000D.

Defined results for odd input: a null text counts as empty; a text without words has all measurements 0 and fails
``few_words`` only; whole texts are measured, whatever their length; equal and null ids stay separate rows; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.batches import map_texts
from seqloom.plans.durable import materialise

#: White space between words, and the characters counted as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: A text with more distinct words than this numbers its windows in two steps, to stay within 63 bits.
WIDE = 1 << 21

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "longest_word")


def rules() -> list[tuple[str, Column]]:
    """(name, failed) in order of the bits.  Add rules at the end, so that stored bits keep their meaning."""
    n = F.col("n_words")
    return [
        ("few_words", n < 50),
        ("repeated_windows", F.col("n_repeat_words") * 100 > n * 50),
        ("symbols", F.col("n_symbols") * 10 > n * 3),
        ("repeated_lines", F.col("n_dup_lines") * 100 > F.col("n_lines") * 40),
        ("short_words", (n > 0) & (F.col("word_chars") < n * 2)),
        ("long_words", (n > 0) & (F.col("word_chars") > n * 20)),
        ("giant_word", F.col("longest_word") > 1000),
    ]


RULE_NAMES = ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "giant_word")
#: Versioned policies: which rules a document must not fail.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": RULE_NAMES,
}


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy, or of a tuple of rule names."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << RULE_NAMES.index(r) for r in names)


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    with_word = [line for line in text.split("\n") if line.strip(SPACE)]
    repeated = 0
    if n > WINDOW:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
        wide = len(number)
        code = ids[:-2] * wide + ids[1:-1]
        if wide > WIDE:
            code = np.unique(code, return_inverse=True)[1]
        code = code * wide + ids[2:]
        order = np.argsort(code, kind="stable")
        ranked = code[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(n - 2, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, dtype=bool)
        for k in range(WINDOW):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    return (
        n,
        len(text) - sum(text.count(c) for c in SPACE),
        sum(text.count(c) for c in SYMBOLS),
        len(with_word) - len(set(with_word)),
        repeated,
        len(with_word),
        max(map(len, words), default=0),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES as long, failed): bit i of ``failed`` is set if rule i fails.  ``longest_word`` is in bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([measure(t) for t in piece.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(MEASURES))
        return pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(rows[:, i]) for i in range(len(MEASURES))]], names=[id_col, *MEASURES])

    measured = map_texts(docs, [id_col, text_col], apply, f"`{id_col}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(failed, 1 << i).otherwise(0) for i, (_, failed) in enumerate(rules())), F.lit(0))
    return measured.withColumn("failed", bits.cast("long"))


def write_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The ledger as a written table: at ``path``, or among the session's intermediates."""
    book = ledger(docs, id_col, text_col)
    if path is None:
        return materialise(book, "quality-ledger")
    book.write.parquet(path)
    return docs.sparkSession.read.schema(book.schema).parquet(path)


def passes(failed: Column, policy: str | tuple[str, ...]) -> Column:
    return failed.bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policy: str = "v2") -> DataFrame:
    """(rule, n_failed, n_only): rows that fail a rule of the policy, and rows that only this rule removes."""
    m = mask(policy)
    hit = F.col("failed").bitwiseAND(F.lit(m))
    names = POLICIES[policy]
    one = {r: 1 << RULE_NAMES.index(r) for r in names}
    sums = book.agg(
        *[F.coalesce(F.sum((hit.bitwiseAND(F.lit(b)) != 0).cast("long")), F.lit(0)).alias(f"f_{r}") for r, b in one.items()],
        *[F.coalesce(F.sum((hit == b).cast("long")), F.lit(0)).alias(f"o_{r}") for r, b in one.items()],
    )
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only")) for r in names])
    return sums.select(F.inline(rows))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = write_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    verdicts = [(~passes(F.col("failed"), "base")).alias("base_failed"), passes(F.col("failed"), "v2").alias("kept"), passes(F.col("failed"), "v1").alias("kept_v1")]
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *verdicts, "failed")


def ledger_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(policy, rule, n_failed, n_only) of every policy, from one ledger."""
    book = write_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    parts = [ablations(book, policy).withColumn("policy", F.lit(policy)) for policy in POLICIES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
s AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, max(octet_length(encode(w))) AS longest FROM p GROUP BY rid),
m AS (SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(s.word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(n.n_lines, 0) AS n_lines, coalesce(s.longest, 0) AS longest
  FROM d LEFT JOIN s USING (rid) LEFT JOIN n USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN n_repeat_words * 100 > n_words * 50 THEN 2 ELSE 0 END + CASE WHEN n_symbols * 10 > n_words * 3 THEN 4 ELSE 0 END
  + CASE WHEN n_dup_lines * 100 > n_lines * 40 THEN 8 ELSE 0 END + CASE WHEN n_words > 0 AND word_chars < n_words * 2 THEN 16 ELSE 0 END
  + CASE WHEN n_words > 0 AND word_chars > n_words * 20 THEN 32 ELSE 0 END + CASE WHEN longest > 1000 THEN 64 ELSE 0 END AS failed FROM m)
"""

OP7_SQL = _LEDGER_SQL + """SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed & 15 = 0 AS kept_v1, CAST(failed AS BIGINT) AS failed FROM b
"""

ABLATIONS_SQL = (
    _LEDGER_SQL
    + ", policies(policy, mask) AS (VALUES "
    + ", ".join(f"('{name}', {mask(name)})" for name in POLICIES)
    + "), every(rule, bit) AS (VALUES "
    + ", ".join(f"('{name}', {1 << i})" for i, name in enumerate(RULE_NAMES))
    + """)
SELECT policy, rule, (SELECT count(*) FROM b WHERE failed & bit <> 0) AS n_failed, (SELECT count(*) FROM b WHERE failed & mask = bit) AS n_only FROM policies JOIN every ON mask & bit <> 0
"""
)
