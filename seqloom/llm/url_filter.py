"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Every URL is expanded into the expressions "last n host labels + first m path characters", but only for the
shapes (n, m) that occur among the rules, however many, so nothing is expanded that could not match.  Expressions meet the
rules in an equi-join on the first 32 bits of SHA-256; the full digest confirms a meeting, and one aggregate
per URL keeps the rule that takes precedence.

Defined results for odd input:

* null URL or no ``://``: host and path are empty, no rule fits, the default verdict holds;
* a rule with a null or empty host, a null path, a path that is neither empty nor starts with ``/``, or a
  null verdict fits nothing and is ignored; of equal rules with both verdicts, ``block`` holds;
* the longest rule wins (characters of host and path); at equal length the longer host;
* repeated rows and equal or null ids stay separate rows; empty tables give empty results (no rules: every URL
  gets the default); columns of the input besides id and url are not read and do not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules (about 200 bytes each) are broadcast; more are shuffled, salted.
MAX_BROADCAST_RULES = 50_000

#: The rules of the registered query (host, path, verdict).
QUERY_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL as columns; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Valid rules, one row per (host, path), with digest, shape and precedence."""
    kept = rules.select(lower_ascii(F.col("host")).alias("host"), F.col("path"), F.col("verdict")).where(
        "host <> '' AND verdict IS NOT NULL AND (path = '' OR path LIKE '/%')"
    )
    text = F.concat("host", "path")
    return (
        kept.groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.sha2(text, 256).alias("r_digest"),
            _labels(F.col("host")).alias("n_labels"),
            F.length("path").alias("n_path"),
            F.struct(F.length(text).alias("len"), F.length("host").alias("host_len"), text.alias("rule"), F.col("verdict").alias("verdict")).alias("r_rule"),
        )
    )


def _expressions(host: Column, path: Column, shapes: dict[int, list[int]]) -> Column:
    """Expressions of a URL for all shapes: path lengths by number of labels.  Each list is one literal, whatever its length."""
    def of(n: int, lengths: list[int]) -> Column:
        every = F.split(F.lit(",".join(map(str, sorted(lengths)))), ",").cast("array<int>")
        suffix = F.substring_index(host, ".", -n)
        fitting = F.filter(every, lambda m: m <= F.length(path))
        return F.when(_labels(host) >= n, F.transform(fitting, lambda m: F.concat(suffix, F.substr(path, F.lit(1), m)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n, lengths) for n, lengths in sorted(shapes.items())])


def judge_urls(
    urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default_verdict: str = "allow", salts: int = 8
) -> DataFrame:
    """One row per row of ``urls``: id, host, path, rule, verdict, rule_matches.

    ``rules`` has host, path, verdict (allow or block).  Up to MAX_BROADCAST_RULES rules are broadcast after counting
    them; larger tables are shuffled to the expressions, and a hot expression is dealt over ``salts`` copies of its
    rule.  ``rule_matches`` counts the rules that fit.
    """
    spark = urls.sparkSession
    ruled = prepare_rules(rules)
    # distinct lengths of paths by number of labels: a few thousand numbers at most, as lengths of rules are
    found = ruled.groupBy("n_labels").agg(F.collect_set("n_path").alias("lengths"), F.count("*").alias("n")).collect()
    shapes = {r["n_labels"]: r["lengths"] for r in found}
    host, path = split_url(F.col(url_col))
    base = urls.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path")).withColumn("_sl_row", F.monotonically_increasing_id())
    if not shapes:
        return base.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default_verdict).alias("verdict"), F.lit(0).cast("long").alias("rule_matches"))
    expanded = base.select("*", F.explode_outer(_expressions(F.col("host"), F.col("path"), shapes)).alias("_sl_expr")).withColumn("_sl_digest", F.sha2("_sl_expr", 256))
    left = expanded.withColumn("_sl_prefix", F.substring("_sl_digest", 1, 8))
    right = ruled.select(F.substring("r_digest", 1, 8).alias("r_prefix"), "r_digest", "r_rule")
    near = F.col("_sl_prefix") == F.col("r_prefix")
    if sum(r["n"] for r in found) <= MAX_BROADCAST_RULES:
        met = left.join(F.broadcast(right), near, "left")
    else:
        left = left.withColumn("_sl_salt", F.pmod("_sl_row", F.lit(salts)).cast("int"))
        right = right.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = left.join(right, near & (F.col("_sl_salt") == F.col("r_salt")), "left")
    confirmed = F.col("_sl_digest") == F.col("r_digest")
    best = met.groupBy("_sl_row", id_col, "host", "path").agg(
        F.max(F.when(confirmed, F.col("r_rule"))).alias("_sl_best"), F.sum(F.when(confirmed, 1).otherwise(0)).alias("rule_matches")
    )
    return best.select(id_col, "host", "path", F.col("_sl_best.rule").alias("rule"), F.coalesce("_sl_best.verdict", F.lit(default_verdict)).alias("verdict"), "rule_matches")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in QUERY_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP1_SQL = """
WITH rules(rh, rp, rv) AS (VALUES ('com','/','allow'), ('example.com','/en/','block'), ('www.example.com','/en/','allow'), ('net','/es/','block'), ('net','/fr/','block')),
rest AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
u AS (SELECT rid, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
m AS (SELECT u.rid, rh || rp AS rule, rv, length(rh || rp) AS n, length(rh) AS hn FROM u JOIN rules ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp)),
b AS (SELECT rid, rule, rv, row_number() OVER (PARTITION BY rid ORDER BY n DESC, hn DESC) AS k, count(*) OVER (PARTITION BY rid) AS c FROM m)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.rv, 'allow') AS verdict, CAST(coalesce(b.c, 0) AS BIGINT) AS rule_matches
FROM u LEFT JOIN b ON b.rid = u.rid AND b.k = 1
"""
