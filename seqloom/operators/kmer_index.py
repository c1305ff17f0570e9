"""A stored index of one sequence's k-mers, reused by many probes.

The words are a table in Spark's buckets by k-mer at a path of the caller's: a probe is dealt by k-mer to the same number of
buckets and merged, and the index side isn't shuffled again.  Buckets aren't sorted: Spark sorts what it merges of a bucketed
table itself, and on writing would compare all words of a bucket by the bucket's number first.  Words with more than
``hot_copies`` copies lie in a table of their own and meet probes over salts, so no bucket holds a hot word; they are found by
counts of SLOTS hashes, so only words of crowded slots are counted themselves.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.matching import HOT_COPIES, SALTS
from seqloom.plans.durable import materialise

BUCKETS = 64
#: Words of a bucket on average, from which there are more buckets; hashes by which hot words are looked for, far more than there can be.
BUCKET_WORDS, SLOTS = 4 << 20, 1 << 16


@dataclass(frozen=True)
class KmerIndex:
    """``name`` is the session's name of the bucketed table (x, kmer) at ``path``/words; ``path``/hot has the other words."""

    name: str
    path: str
    kind: str
    buckets: int


def build(kmers: DataFrame, path: str, buckets: int = BUCKETS, hot_copies: int = HOT_COPIES) -> KmerIndex:
    """Store (pos, kmer) at a new path, in at least ``buckets`` buckets."""
    words = materialise(kmers.select(F.col("pos").alias("x"), "kmer"), "index-words")
    slot = F.pmod(F.xxhash64("kmer"), F.lit(SLOTS)).alias("slot")
    slots = materialise(words.groupBy(slot).count(), "index-slots")
    total = slots.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    bound, buckets = max(hot_copies, total // 2000), max(buckets, -(-total // BUCKET_WORDS))
    crowded = F.broadcast(slots.where(F.col("count") > bound).select("slot"))  # SLOTS rows at most
    some = words.select("kmer", slot).join(crowded, "slot", "left_semi")
    hot = materialise(some.groupBy("kmer").count().where(F.col("count") > bound).select("kmer"), "index-hot")  # at most 2000 rows
    few = F.broadcast(hot)
    words.join(few, "kmer", "left_semi").select("x", "kmer").write.parquet(f"{path}/hot")
    rest = words.join(few, "kmer", "left_anti").select("x", "kmer").repartition(buckets, "kmer")
    index = KmerIndex(f"kmers_{uuid.uuid4().hex}", path, dict(words.dtypes)["kmer"], buckets)
    rest.write.bucketBy(buckets, "kmer").option("path", f"{path}/words").saveAsTable(index.name)
    return index


def open_index(spark: SparkSession, path: str, kind: str, buckets: int) -> KmerIndex:
    """Name an index that another session has built; kind is the type of its k-mers."""
    index = KmerIndex(f"kmers_{uuid.uuid4().hex}", path, kind, buckets)
    spark.sql(f"CREATE TABLE {index.name} (x BIGINT, kmer {kind}) USING parquet CLUSTERED BY (kmer) INTO {buckets} BUCKETS LOCATION '{path}/words'")
    return index


def forget(spark: SparkSession, index: KmerIndex) -> None:
    """Drop the session's name; the files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {index.name}")


def probe(index: KmerIndex, kmers: DataFrame, salts: int = SALTS, few: int = 0) -> DataFrame:
    """(x, y, kmer) of all matches of the index with (pos, kmer).

    With ``few``, words that are counted to be at most so many are broadcast, and the index is read without a sort.
    """
    spark = kmers.sparkSession
    ys = kmers.select(F.col("pos").alias("y"), "kmer")
    hot = spark.read.schema(f"x long, kmer {index.kind}").parquet(f"{index.path}/hot")
    if few:
        ys = materialise(ys, "probe-words")
        if ys.count() <= few:
            return spark.table(index.name).unionByName(hot).join(F.broadcast(ys), "kmer").select("x", "y", "kmer")
    met = spark.table(index.name).join(ys.hint("merge"), "kmer").select("x", "y", "kmer")
    if hot.isEmpty():
        return met
    few = F.broadcast(hot.select("kmer").distinct())  # at most 2000 rows
    xs = hot.withColumn("_salt", F.pmod("x", F.lit(salts)))
    copies = ys.join(few, "kmer", "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return met.unionByName(xs.join(copies, ["kmer", "_salt"]).select("x", "y", "kmer"))
