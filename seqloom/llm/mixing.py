"""Mixing sources to target weights by Pareto order sampling.

1. Every source gets a target number of words: its weight's share of all words, held at ``max_copies`` times the
   source's own words, the excess reshared by weight among the others (water-filling, in closed form).
2. Within a source every document has a relative weight of its own, by default the square root of its words, so that long
   documents are likelier than short ones.  Its expected copies e are proportional to that weight, held at
   ``max_copies``, and such that the expected words of the source are its target (water-filling again).  Weights
   count in classes of 2**(1/STEPS), so that this is solved over a few sums per source and not over documents.
3. A document certainly enters floor(e) times.  The rest of the target is filled by Pareto order sampling with the
   unequal inclusion probabilities p = e - floor(e): with a uniform u made from the id, documents are ranked by the odds
   ratio [u/(1-u)] / [p/(1-p)], and the first ones enter once more, up to the rank at which their words come nearest to
   the rest.  Fixed size means words here.

The cut is found without sorting a source in one task: ranks are mapped to (0, 1), words are summed by (source, bin),
the bin that holds the cut is found over at most ``BINS`` sums per source, its documents are binned again, and only
the documents of that bin of a bin are ordered.  Each level reads a table of (id, source, size, rank), never the text.

Defined results for odd input: a null text has size 0; null sources are one source, last in order; empty texts take
0 words; a document's weight that is null, NaN or not above 0 counts as 1; a source's weight that is null, NaN or not
above 0 gives it the target 0; repeated rows draw numbers of their own and are interchangeable; an empty table gives
an empty result; other columns are not read and do not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.plans.durable import join_small, materialise

#: Bins per level; two levels leave about n / BINS**2 documents of a source to order.
BINS = 2048
#: Weights in order of the sources' names, repeating.
CYCLE = (1, 2, 3)
SEED = "mix-1"
#: Classes of documents' weights in each doubling.
STEPS = 8
#: What the mix needs of a document.
KEY = ["_sl_id", "_sl_source", "_sl_size", "_sl_class"]


def count_words(text: Column) -> Column:
    """Number of runs of anything but space and U+0009 to U+000D; null counts 0."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")
    return F.length(F.regexp_replace(marks, r"^[\x20\x09-\x0D]++", "")).cast("long")


def uniform(doc_id: Column, ordinal: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from seed, id and the number of the repetition: 48 bits of MD5, middle of their interval."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), ordinal.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


def _positive(weight: Column) -> Column:
    w = weight.cast("double")
    return F.when(w.isNotNull() & ~F.isnan(w) & (w > 0), w)


def weight_class(weight: Column) -> Column:
    """The class of a document's weight: its logarithm in steps of 2**(1/STEPS)."""
    steps = F.round(F.log2(F.coalesce(_positive(weight), F.lit(1.0))) * STEPS)
    return F.least(F.greatest(steps, F.lit(-64.0 * STEPS)), F.lit(64.0 * STEPS)).cast("int")


def source_targets(sources: DataFrame, weights: Column | None = None, max_copies: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, so windows over all of it are small.

    ``weights``: column over ``source``; by default CYCLE in code-point order of the names, null last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in CYCLE]), (n % len(CYCLE) + 1).cast("int"))
    t = sources.withColumn("_sl_w", F.coalesce(_positive(weights), F.lit(0.0)) if weights is not None else cycle)
    t = t.withColumn("_sl_cap", F.when(F.col("_sl_w") > 0, F.col("source_size") * max_copies).otherwise(0))
    t = t.withColumn("_sl_ratio", F.when(F.col("_sl_w") > 0, F.col("_sl_cap") / F.col("_sl_w")).otherwise(0.0))
    before = Window.orderBy("_sl_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_sl_cap").over(before), F.lit(0))
    share = F.sum("_sl_w").over(every) - F.coalesce(F.sum("_sl_w").over(before), F.lit(0.0))
    t = t.withColumn("_sl_level", F.when(F.col("_sl_w") > 0, left / share))
    free = F.col("_sl_ratio") >= F.col("_sl_level")
    t = t.withColumn("_sl_level", F.min(F.when(free, F.struct("_sl_ratio", F.col("source").isNull(), "source", "_sl_level"))).over(every)["_sl_level"])
    level = F.when(F.col("_sl_w") > 0, F.coalesce(F.col("_sl_level") * F.col("_sl_w"), F.when(F.col("source_size") > 0, F.col("_sl_cap").cast("double")).otherwise(0.0))).otherwise(0.0)
    return t.select("source", "source_size", F.least(F.col("_sl_cap").cast("double"), level).alias("target"))


def expected_copies(classes: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """(source, class, size, source_size, target, e) from (source, class, size) and (source, source_size, target).

    From the heaviest class on, classes are held at ``max_copies`` until the level that the others then get fits all of
    them.  A source has at most 128 * STEPS classes.
    """
    t = classes.join(targets.withColumnRenamed("source", "_sl_s"), F.col("source").eqNullSafe(F.col("_sl_s"))).drop("_sl_s")
    t = t.withColumn("_sl_w", F.pow(F.lit(2.0), F.col("class") / float(STEPS)))
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    held = F.coalesce(F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * max_copies
    free = F.sum(F.col("_sl_w") * F.col("size")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("_sl_level", F.when(free > 0, (F.col("target") - held) / free))
    fits = F.col("_sl_level") * F.col("_sl_w") <= max_copies
    level = F.max(F.when(fits, F.struct("class", "_sl_level"))).over(Window.partitionBy("source"))["_sl_level"]
    e = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_copies)), F.coalesce(level * F.col("_sl_w"), F.lit(float(max_copies))))).otherwise(0.0)
    return t.select("source", "class", "size", "source_size", "target", F.greatest(e, F.lit(0.0)).alias("e"))


def _ordinals(rows: DataFrame) -> DataFrame:
    """Number rows that agree in id, source and size, 0 for all others; such rows are interchangeable.

    Rows are numbered within (input partition, key) and shifted by the counts of earlier partitions, so a key with
    many repetitions is never gathered in one task.  Further columns of ``rows`` are kept.
    """
    many = rows.groupBy(*KEY).count().where("count > 1").select(*KEY)
    many = materialise(many, "mix-repeated")
    if many.isEmpty():
        return rows.withColumn("_sl_ordinal", F.lit(0).cast("long"))
    marked = join_small(rows, many.withColumn("_sl_many", F.lit(True)), KEY, F.rand(7))
    rest = marked.where("_sl_many IS NULL").drop("_sl_many").withColumn("_sl_ordinal", F.lit(0).cast("long"))
    same = materialise(marked.where("_sl_many").drop("_sl_many").withColumn("_sl_part", F.spark_partition_id()), "mix-same")
    local = Window.partitionBy("_sl_part", *KEY).orderBy("_sl_size")
    earlier = Window.partitionBy(*KEY).orderBy("_sl_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = same.groupBy("_sl_part", *KEY).agg(F.count("*").alias("_sl_n")).withColumn("_sl_shift", F.coalesce(F.sum("_sl_n").over(earlier), F.lit(0))).drop("_sl_n")
    numbered = join_small(same.withColumn("_sl_at", F.row_number().over(local) - 1), materialise(shift, "mix-shift"), ["_sl_part", *KEY], F.col("_sl_at"))
    return rest.unionByName(numbered.select(*rows.columns, (F.col("_sl_at") + F.col("_sl_shift")).cast("long").alias("_sl_ordinal")))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, doc_weight: Column | None) -> DataFrame:
    """``docs`` with the columns of KEY."""
    wide = docs.withColumns({"_sl_id": F.col(id_col), "_sl_source": F.col(source_col), "_sl_size": count_words(F.col(text_col))})
    return wide.withColumn("_sl_class", weight_class(F.sqrt(F.col("_sl_size").cast("double")) if doc_weight is None else doc_weight))


def _ranked(rows: DataFrame, expected: DataFrame, seed: str) -> DataFrame:
    """``rows`` with their source's target, whole copies and rank; the text is not needed any more."""
    rows = _ordinals(rows).withColumn("_sl_u", uniform(F.col("_sl_id"), F.col("_sl_ordinal"), seed))
    rows = join_small(rows, expected, ["_sl_source", "_sl_class"], F.col("_sl_id"))
    rows = rows.withColumn("_sl_whole", F.floor("_sl_e")).withColumn("_sl_p", F.col("_sl_e") - F.floor("_sl_e"))
    odds = (F.col("_sl_u") / (1 - F.col("_sl_u"))) * ((1 - F.col("_sl_p")) / F.col("_sl_p"))
    rows = rows.withColumn("_sl_rank", F.when((F.col("_sl_p") > 0) & (F.col("_sl_size") > 0), odds / (1 + odds)))
    fine = F.least(F.floor(F.col("_sl_rank") * (BINS * BINS)), F.lit(BINS * BINS - 1))
    return rows.withColumn("_sl_bin", F.floor(fine / BINS)).withColumn("_sl_sub", fine % BINS)


def _cut(rows: DataFrame, wanted: DataFrame, bin_col: str) -> DataFrame:
    """Per source the last bin that begins at or before the wanted words: (source, cut, wanted words within it)."""
    sums = rows.groupBy(F.col("_sl_source").alias("_s"), bin_col).agg(F.sum("_sl_size").alias("s"))
    before = Window.partitionBy("_s").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("b", F.coalesce(F.sum("s").over(before), F.lit(0)))
    both = sums.join(wanted, F.col("_s").eqNullSafe(F.col("_sl_source"))).where(F.col("b") <= F.col("_sl_want"))
    best = both.groupBy("_sl_source").agg(F.max(F.struct(bin_col, (F.col("_sl_want") - F.col("b")).alias("w"))).alias("m"))
    return best.select("_sl_source", F.col(f"m.{bin_col}").alias(f"{bin_col}_cut"), F.col("m.w").alias("_sl_want"))


def _thresholds(slim: DataFrame, source_weight: Column | None, max_copies: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(expected copies by source and class, where each source's ranking is cut), both written tables."""
    classes = materialise(slim.groupBy(F.col("_sl_source").alias("source"), F.col("_sl_class").alias("class")).agg(F.sum("_sl_size").alias("size")), "mix-classes")
    totals = classes.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = expected_copies(classes, source_targets(totals, source_weight, max_copies), max_copies)
    names = {"source": "_sl_source", "class": "_sl_class", "size": "_sl_words", "source_size": "_sl_total", "target": "_sl_target", "e": "_sl_e"}
    every = materialise(found.withColumnsRenamed(names), "mix-expected")
    expected = every.drop("_sl_words")
    rows = _ranked(slim, expected, seed).where("_sl_rank IS NOT NULL")
    want = every.groupBy("_sl_source").agg((F.first("_sl_target") - F.sum(F.floor("_sl_e") * F.col("_sl_words"))).alias("_sl_want"))
    cut1 = materialise(_cut(rows, want, "_sl_bin"), "mix-cut")
    inner = join_small(rows, cut1.drop("_sl_want"), ["_sl_source"], F.col("_sl_id"), "inner").where("_sl_bin = _sl_bin_cut")
    cut2 = materialise(_cut(inner, cut1.select("_sl_source", "_sl_want"), "_sl_sub"), "mix-cut")
    last = join_small(inner, cut2, ["_sl_source"], F.col("_sl_id"), "inner").where("_sl_sub = _sl_sub_cut")
    order = Window.partitionBy("_sl_source").orderBy("_sl_rank", F.col("_sl_id").asc_nulls_last(), "_sl_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("_sl_upto", F.sum("_sl_size").over(order))
    # a document enters if the middle of its words lies before the cut
    entered = last.where(F.col("_sl_upto") - F.col("_sl_size") / 2 <= F.col("_sl_want")).groupBy(F.col("_sl_source").alias("_s3")).agg(F.max(F.struct("_sl_rank", "_sl_id", "_sl_size")).alias("_sl_end"))
    ends = cut1.drop("_sl_want").join(cut2.select(F.col("_sl_source").alias("_s2"), "_sl_sub_cut"), F.col("_sl_source").eqNullSafe(F.col("_s2")), "left")
    ends = ends.join(entered, F.col("_sl_source").eqNullSafe(F.col("_s3")), "left").drop("_s2", "_s3")
    return expected, materialise(ends, "mix-ends")


def _with_copies(rows: DataFrame, expected: DataFrame, ends: DataFrame, seed: str) -> DataFrame:
    done = join_small(_ranked(rows, expected, seed), ends, ["_sl_source"], F.col("_sl_id"))
    place = F.col("_sl_bin") * BINS + F.col("_sl_sub")
    cut = F.col("_sl_bin_cut") * BINS + F.col("_sl_sub_cut")
    far = F.lit((1 << 63) - 1)

    def by(rank: Column, doc_id: Column, size: Column) -> Column:
        return F.struct(rank.alias("r"), F.coalesce(doc_id.cast("string"), far.cast("string")).alias("i"), size.alias("s"))

    upto_end = by(F.col("_sl_rank"), F.col("_sl_id"), F.col("_sl_size")) <= by(F.col("_sl_end._sl_rank"), F.col("_sl_end._sl_id"), F.col("_sl_end._sl_size"))
    more = (place < cut) | ((place == cut) & F.col("_sl_end").isNotNull() & upto_end)
    return done.withColumn("_sl_copies", (F.col("_sl_whole") + F.when(more, 1).otherwise(0)).cast("int"))


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", source_weight: Column | None = None, doc_weight: Column | None = None, max_copies: int = 3, seed: str = SEED
) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, expected, copies).

    ``source_weight`` is a column over ``source``, by default CYCLE in order of the names; ``doc_weight`` one over the
    columns of ``docs``, by default the square root of the words (``F.lit(1)`` makes all documents of a source alike).
    The sum of copies * size of a source comes within half a document of its target.
    """
    slim = materialise(_keyed(docs, id_col, text_col, source_col, doc_weight).select(*KEY), "mix-sizes")
    done = _with_copies(slim, *_thresholds(slim, source_weight, max_copies, seed), seed)
    names = {"_sl_id": "doc_id", "_sl_source": "source", "_sl_size": "size", "_sl_total": "source_size", "_sl_target": "target", "_sl_e": "expected", "_sl_copies": "copies"}
    return done.select(*[F.col(k).alias(v) for k, v in names.items()])


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", source_weight: Column | None = None, doc_weight: Column | None = None, max_copies: int = 3, seed: str = SEED
) -> DataFrame:
    """``docs`` itself, each row as often as the mix takes it; options as in ``plan_mix``.

    Rows are decided where they lie, by a table of thresholds per source, so texts are not shuffled; the price is that
    their words are counted twice.
    """
    wide = _keyed(docs, id_col, text_col, source_col, doc_weight)
    slim = materialise(wide.select(*KEY), "mix-sizes")
    done = _with_copies(wide, *_thresholds(slim, source_weight, max_copies, seed), seed)
    kept = done.where("_sl_copies > 0").withColumn("_sl_copy", F.explode(F.sequence(F.lit(1), F.col("_sl_copies"))))
    return kept.select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP9_SQL = """
WITH d AS (SELECT doc_id, source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 'w', 'g'), '^[\\x20\\x09-\\x0D]+', '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3 AS cap FROM s),
r AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0)) AS lev FROM r
  WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT min(lev) AS lev FROM (SELECT lev FROM l WHERE ratio >= lev ORDER BY ratio, source NULLS LAST LIMIT 1)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(v.lev * w, 0.0)) AS target FROM l, v),
k AS (SELECT *, CAST(round(log2(CASE WHEN size > 0 THEN sqrt(CAST(size AS DOUBLE)) ELSE 1.0::DOUBLE END) * 8) AS INTEGER) AS class FROM d),
c AS (SELECT source, class, sum(size) AS words, pow(2.0::DOUBLE, class / 8.0::DOUBLE) AS w FROM k GROUP BY source, class),
g AS (SELECT c.*, t.source_size, t.target, (t.target - 3 * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / nullif(sum(w * words) OVER (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS lev FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
h AS (SELECT source, max_by(lev, class) FILTER (lev * w <= 3) AS lev FROM g GROUP BY source),
x AS (SELECT g.source, g.class, g.words, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN greatest(least(3.0::DOUBLE, coalesce(h.lev * g.w, 3.0::DOUBLE)), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS e FROM g JOIN h ON g.source IS NOT DISTINCT FROM h.source),
y AS (SELECT source, any_value(target) - sum(floor(e) * words) AS want FROM x GROUP BY source),
e AS (SELECT k.doc_id, k.source, k.size, x.source_size, x.target, floor(x.e) AS whole, x.e - floor(x.e) AS p,
  (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || (row_number() OVER (PARTITION BY k.doc_id, k.source, k.size) - 1)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM k JOIN x ON k.source IS NOT DISTINCT FROM x.source AND k.class = x.class),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS odds FROM e),
z AS (SELECT *, sum(CASE WHEN odds IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN odds IS NOT NULL AND upto - size / 2 <= want THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM z JOIN y ON z.source IS NOT DISTINCT FROM y.source
"""
