"""Texts of buckets that stay crowded."""

import random

import pytest

from seqloom.llm import simhash


def test_texts_outside_of_their_leaders_component_meet_all_others(spark):
    last = spark.createDataFrame([(fp, 0, 1) for fp in (1, 2, 3, 4, 5, 7, 2**40 - 1)] + [(64, 1, 64), (65, 1, 64)], "fp long, t byte, leader long")
    found = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (64, 65)], "a long, b long")
    got = {tuple(r) for r in simhash._outside(last, found, 4).collect()}
    inside, outside = (1, 2, 3), (4, 5, 7)
    # 7 stands alone, 4 and 5 are one component, the last one is far from all
    assert got == {(a, b) for a in inside for b in outside} | {(4, 7), (5, 7)}


def test_each_leader_of_a_group_is_met_once(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 8)
    rows = [(fp, [7], [11, 12, 13, 14, 15, 16, 17, 18]) for fp in range(1, 31)]
    classes = spark.createDataFrame(rows, "fp long, keys array<long>, heavy array<long>")
    seen = []
    real = simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, tag: seen.append(real(df, tag)) or seen[-1])
    pairs, last = simhash.candidate_links(classes)
    made = [r["new"] for df in seen if "new" in df.columns for r in df.collect()]
    assert sum(map(len, made)) == 30 * simhash.LEADERS[0]
    assert {r["fp"] for r in last.collect()} == set(range(1, 31))
    ends = {frozenset((r["a"], r["b"])) for r in pairs.collect()}
    assert len(ends) == 8 * 22 + 8 * 7 // 2


@pytest.mark.parametrize("part", [(128, 2048), (3, 3)])
def test_texts_outside_are_joined_as_by_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(40):  # pairs are around the similarity of 0.8
        own = list(base)
        for j in range(rng.choice([0, 1, 2, 3, 4])):
            own[rng.randrange(len(own))] = f"x{i}_{j}"
        texts.append((i, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    prints = {i: simhash.sketch(t, 5) for i, t in texts}
    fp = {i: int(s[0][0]) for i, s in prints.items()}
    sets = {fp[i]: set(s[2].tolist()) for i, s in prints.items()}
    classes = spark.createDataFrame([(f, min(i for i in fp if fp[i] == f)) for f in sets], "fp long, first_id long")
    last = spark.createDataFrame([(f, t, fp[t]) for f in sets for t in (0, 1)], "fp long, t byte, leader long")
    known = [tuple(sorted((fp[2], fp[3])))]
    found = spark.createDataFrame(known, "a long, b long")
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    pairs = [tuple(r) for r in simhash._outside(last, found, 64).collect()]
    want = [p for p in pairs if alike(*p)]
    got = [tuple(r) for r in simhash._outside_links(last, found, 0.8, docs, classes, "doc_id", "text", 5).collect()]

    def components(edges):
        at = {f: f for f in sets}
        for a, b in edges:
            one, other = at[a], at[b]
            at = {f: one if x == other else x for f, x in at.items()}
        return {frozenset(f for f in sets if at[f] == x) for x in at.values()}

    assert 1 < len(components(want + known)) < len(sets) - 5
    assert components(got + known) == components(want + known) and all(alike(*p) for p in got)
    # a pair of parts gives no more links than it has texts, whatever the number of pairs
    if part[0] == 128:
        assert len(got) <= 2 * len(sets) < len(pairs)
