import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import metric_tree

TABLE = "vec_id long, embedding array<float>, label int, row long, id long, v string, score int, region int, rank string"


def table_of(spark, vectors):
    """vectors: (id, components)."""
    return spark.createDataFrame([(i, v, 1, 5, 6, "v", 7, 8, "r") for i, v in vectors], TABLE)


def brute_force(vectors, k=20, every=20):
    own = []
    for i, v in vectors:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(64 * float(np.float32(x))) for x in v]
            if sum(x * x for x in q) < 1 << 62:
                own.append((i, q))
    out = []
    for at, (i, q) in enumerate(own):
        if i is not None and i % every == 0:
            found = [(-sum(a * b for a, b in zip(q, p)), j is None, j or 0, j) for other, (j, p) in enumerate(own) if other != at]
            out += [(i, rank + 1, j, -s) for rank, (s, _, _, j) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(map(repr, out))


def cloud(n, dim, seed, centres=6):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(centres, dim))
    return [[float(x) for x in mid[rng.integers(centres)] * rng.uniform(0.3, 2) + rng.normal(size=dim) * 0.2] for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"shard": 40, "max_pivots": 5, "block": 3, "page": 8}, {"shard": 7, "max_pivots": 1, "block": 2, "page": 2}])
def test_top_k_matches_brute_force(spark, sizes):
    rng = random.Random(2)
    vectors = [(i, v) for i, v in enumerate(cloud(260, 5, 1))]
    same = vectors[0][1]
    vectors += [(rng.choice([None, *range(1000)]), list(same)) for _ in range(120)]  # a third are copies, ties everywhere
    vectors += [(i, v) for i, v in vectors[:25]]  # repeated rows
    vectors += [(400, None), (420, [1.0, None, 2.0]), (440, [float("nan")]), (460, [float("inf"), 1.0]), (480, []), (500, [0.0] * 5), (520, [1.5]), (None, [2.0] * 9), (540, [3.0] * 9)]
    rng.shuffle(vectors)
    got = metric_tree.top_k(table_of(spark, vectors).repartition(3), **sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_force(vectors)


def test_few_rows_and_none(spark):
    assert metric_tree.top_k(table_of(spark, [])).count() == 0
    assert metric_tree.top_k(table_of(spark, [(20, [1.0, 2.0])])).count() == 0
    assert metric_tree.top_k(table_of(spark, [(20, None), (40, [None])])).count() == 0
    assert [tuple(r) for r in metric_tree.top_k(table_of(spark, [(20, [1.0, -2.0]), (3, [0.5, 0.01])])).collect()] == [(20, 1, 3, 64 * 32)]


def test_large_components_stay_exact(spark):
    rng = random.Random(5)
    vectors = [(i, [float(np.float32(rng.uniform(-1, 1) * 2.0**24)) for _ in range(4)]) for i in range(60)] + [(80, [1e30, 1.0]), (100, [3.0e38])]
    assert sorted(repr(tuple(r)) for r in metric_tree.top_k(table_of(spark, vectors)).collect()) == brute_force(vectors)


def test_pages_keep_the_bounds_of_a_metric_tree():
    vectors = np.unique(np.floor(64 * np.array(cloud(900, 6, 4))).astype(np.int64), axis=0)
    largest = float((vectors.astype(float) ** 2).sum(axis=1).max())
    pages, lifted = metric_tree.load_pages(vectors, largest, page=16, fanout=4), metric_tree._lifted(vectors, largest)
    at = {tuple(v): i for i, v in enumerate(vectors.tolist())}

    def below(number):
        p = pages[number]
        return [int(c) for c in p.children] if p.leaf else [x for c in p.children for x in below(int(c))]

    assert sorted(below(0)) == list(range(len(vectors))) and max(len(p.radii) for p in pages) <= 16
    for p in pages:
        if not p.leaf:
            for vector, radius, child in zip(p.vectors.tolist(), p.radii, p.children):
                routing = lifted[at[tuple(vector)]][None]
                assert np.linalg.norm(lifted[below(int(child))] - routing, axis=1).max() <= radius + 1e-6
                own = lifted[[at[tuple(v)] for v in pages[int(child)].vectors.tolist()]]
                assert np.allclose(np.linalg.norm(own - routing, axis=1), pages[int(child)].to_parent, atol=1e-3)


def test_search_avoids_products():
    vectors = np.unique(np.floor(64 * np.array(cloud(4000, 6, 9, centres=40))).astype(np.int64), axis=0)
    largest, n = float((vectors.astype(float) ** 2).sum(axis=1).max()), len(vectors)
    tree = metric_tree.Tree(metric_tree.load_pages(vectors, largest, page=16), largest, np.arange(n + 1), np.arange(n), np.arange(n))
    for own in range(0, n, 100):
        scores, ids, _ = tree.search(vectors[own], 20, own)
        every = vectors @ vectors[own]
        want = sorted((-int(s), i) for i, s in enumerate(every) if i != own)[:20]
        assert list(zip((-scores).tolist(), ids.tolist())) == want
        least = int(scores[9])
        assert tree.search(vectors[own], 20, own, least)[0].tolist() == [s for s in scores.tolist() if s >= least][:20]
    assert tree.computed < 0.7 * 2 * n * len(range(0, n, 100))


def test_query_matches_sql(spark, tmp_path):
    vectors = [(i // 2, v) for i, v in enumerate(cloud(150, 4, 7))] + [(20, None), (None, [0.1] * 4), (33, [1.0, None, 1.0, 1.0])]
    table = table_of(spark, vectors)
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    rel = con.sql(metric_tree.OP11_SQL)
    got = metric_tree.op11_top_k(spark, str(tmp_path))
    assert got.columns == rel.columns
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, rel.fetchall())) == brute_force(vectors)
    assert got.where(F.col("rank") == 1).count() > 0
