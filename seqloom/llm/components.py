"""Connected components of a table of links, by alternating large-star and small-star rounds.

The links never leave the executors; each round is written to the shared folder.  Minima are partial aggregates and
the joins deal hot nodes over salts, so the centre of a large star isn't gathered in one task.  The number of rounds
grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.durable import join_small, materialise


#: Up to so many links are one partition, so that a round of a small graph needs no exchange.
SMALL = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link to another node; root is the smallest node of the component."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = materialise(edges, "cc-links")
    seen = _state(edges)
    while seen[0]:
        few = seen[0] <= SMALL

        def dealt(df: DataFrame, few: bool = few) -> DataFrame:
            return df.coalesce(1) if few else df

        both = dealt(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        lowest = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
        large = join_small(both, lowest, ["u"], F.col("v"), "inner").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = dealt(materialise(dealt(large).distinct(), "cc-large"))
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        joined = join_small(large, least, ["u"], F.col("v"), "inner")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = materialise(dealt(small).distinct(), "cc-small")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
