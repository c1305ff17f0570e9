"""Ties, short records, empty regions and joins of large sides."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from seqloom import queries
from seqloom.operators import kmer_index, matching, methylation, sequence
from seqloom.plans.scale import TileScale
from seqloom.sources import fasta


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("side", [400, 1000])
def test_large_sides_are_merged_and_not_broadcast(spark, side):
    pieces = spark.createDataFrame([(0, "ACGTTGCA" * 200)], "pos long, bases string")
    own = sequence.words(pieces, 5)
    scale = TileScale.fit(side, 1600, 1600)
    hits = matching.tile_hits(own, own, scale, hot_tiles=500, few=0)
    assert "BroadcastHashJoin" not in _plan(hits)
    want = {tuple(r) for r in matching.raw_tile_hits(own, own, scale).collect()}
    assert {tuple(r) for r in hits.collect()} == want
    other = sequence.words(pieces, 5)
    for few in (0, 10_000):
        assert {tuple(r) for r in matching.tile_hits(own, other, scale, hot_tiles=500, few=few).collect()} == want
    assert "BroadcastHashJoin" not in _plan(matching.match_pairs(own, own, few=0))


def test_black_tiles_are_merged_and_not_broadcast(spark):
    own = sequence.words(spark.createDataFrame([(0, "ACGTTGCA" * 200)], "pos long, bases string"), 5)
    scale = TileScale.fit(400, 1600, 1600)
    black = matching.black_tiles(own, own, scale)
    assert "BroadcastHashJoin" not in _plan(black)
    assert {tuple(r) for r in black.collect()} == {tuple(r)[:2] for r in matching.raw_tile_hits(own, own, scale).collect()}


@pytest.mark.parametrize("hot", [10_000, 150])
def test_index_of_more_words_has_more_buckets_and_is_read_unsorted_by_few(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(kmer_index, "BUCKET_WORDS", 100)
    own = sequence.words(spark.createDataFrame([(0, "ACGTTGCA" * 200 + "A" * 300)], "pos long, bases string"), 5)
    want = sorted(map(tuple, matching.match_pairs(own, own).collect()))
    index = kmer_index.build(own, str(tmp_path / "index"), 4, hot)
    assert index.buckets == 19  # 1,896 words
    assert (spark.read.parquet(f"{index.path}/hot").count() > 0) == (hot == 150)
    for few in (0, 10_000):
        found = kmer_index.probe(index, own, few=few)
        assert sorted(map(tuple, found.collect())) == want
        assert few == 0 or " Sort " not in _plan(found) and "Exchange hashpartitioning" not in _plan(found)
    kmer_index.forget(spark, index)


@pytest.mark.parametrize("turned", [False, True])
def test_last_contig_wins_where_offsets_are_equal(spark, turned):
    rows = [(1, "a", 4, 0), (2, "b", 0, 4), (3, "c", 0, 4), (4, "d", 9, 4)]
    contigs = spark.createDataFrame(rows[::-1] if turned else rows, "ord long, id string, n long, off long").coalesce(1)
    track = spark.createDataFrame([(i, c, 2, 3, float(i)) for i, c in enumerate("dcba" if turned else "abcd", 1)], "line_no long, chrom string, start long, end long, value float")
    sites = methylation.track_stages(track, contigs, None).sites.collect()
    last = 1.0 if turned else 4.0
    assert {s["pos"]: s["pct"] for s in sites} == {2: 4.0 if turned else 1.0, 6: last}


def test_symbols_whose_upper_case_is_longer(spark):
    lines = spark.createDataFrame([(0, i, x) for i, x in enumerate([">a", "acßt", "ŉ", "ﬁ", "ẗ", "ᾳ", "r"])], "split long, line_no long, line string")
    found = {r["line_no"]: r["problem"] for r in fasta.violations(fasta.parse_fasta(lines)).collect()}
    assert found == {1: "invalid symbol ẞ", 2: "invalid symbol ŉ", 3: "invalid symbol ﬁ", 4: "invalid symbol ẗ", 5: "invalid symbol ᾼ", 6: "invalid symbol R"}
    assert fasta.contigs_of_lines(fasta.parse_fasta(lines)).first()["n"] == 9


@pytest.fixture
def tables(spark, tmp_path):
    def made(text):
        docs = [(0, "ACGT" * 10), (3, text), (5, "GATTACA" * 20_000)]
        spark.createDataFrame([d for d in docs if d[1] != "gone"], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([(1, 77, 50.0)], "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
        return str(tmp_path)

    return made


@pytest.mark.parametrize("text", ["ACGTACGTACGTAC", "ACG", None, "gone"])
def test_regions_past_their_record(spark, tables, text):
    at, own = tables(text), [] if text == "gone" else [(text or "")[10:]]
    md5 = [hashlib.md5(s.encode()).hexdigest() for s in own]
    assert [tuple(r) for r in queries.q_region_id_slice(spark, at).collect()] == [(0, m, 190) for m in md5]
    indexed = {(r["region"], r["pos"]): r["digest"] for r in queries.q_fasta_indexed(spark, at).collect() if r["region"] == "id_slice"}
    assert indexed == {("id_slice", 0): m for m, s in zip(md5, own, strict=True) if s}


def test_regions_without_sites(spark, tables):
    assert queries.q_track_last_of_a_name(spark, tables("A")).collect() == []


@pytest.mark.parametrize("name", ["q_sql_colors", "q_track_fractions", "q_track_not_a_number", "q_track_prune", "q_track_reverse", "q_track_table"])
def test_sites_of_equal_offsets_that_the_sql_leaves_open(spark, tmp_path, name):
    """The SQL's ``arg_max(v, off)`` takes any of the contigs that share an offset, the query the last: equal if ``ord`` settles it."""
    import duckdb

    docs = [(0, "ACGT" * 10), (1, "-"), (2, "-"), (3, "C" * 400), (4, "-")]
    events = [(i + 400 * u, u, float((7 * i + 31 * u) % 100 * 5)) for i in range(40) for u in (3, 1, 4, 2, 0)]
    con = duckdb.connect()
    for table, rows, columns in (("documents", docs, "doc_id long, text string"), ("events", events, "event_id long, user_id long, value double")):
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{table}.parquet"))
        con.sql(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    settled = queries.ORACLES[name].replace("arg_max(v, off)", "arg_max(v, (off, ord))")
    assert settled != queries.ORACLES[name]
    want = con.sql(settled)
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_own_pairs_are_summed_without_making_them(spark, tables):
    """Texts of few words match themselves 3 * 10**9 times; the query makes pairs of tiles, not of copies."""
    at, sizes = tables("A" * 20_000), {}
    sums = queries.q_match_pairs_self(spark, at)
    assert not any("Join" in line and "kmer" in line for line in _plan(sums).splitlines())
    docs = "ACGT" * 10 + "A" * 20_000 + "GATTACA" * 20_000
    words = {}
    for i in range(len(docs) - queries.K + 1):
        words.setdefault(docs[i : i + queries.K], []).append(i)
    for places in words.values():
        tiles = {}
        for x in places:
            n, s = tiles.get(x // 4096, (0, 0))
            tiles[x // 4096] = (n + 1, s + x)
        for bx, (n, s) in tiles.items():
            for by, (m, r) in tiles.items():
                was = sizes.get((bx, by), (0, 0))
                sizes[bx, by] = (was[0] + n * m, was[1] + s * m - n * r)
    assert {(r["bx"], r["by"]): (r["n"], r["shift"]) for r in sums.collect()} == sizes


@pytest.mark.parametrize("parts", [40, 1 << 21])
def test_own_pair_sums_and_black_tiles_are_those_of_all_pairs(spark, monkeypatch, parts):
    monkeypatch.setattr(matching, "PART_WORDS", parts)
    pieces = spark.createDataFrame([(0, "ACGTTGCAAC" * 40 + "N" + "TTGACCA" * 30)], "pos long, bases string")
    own = sequence.words(pieces, 4)
    pairs = [(r["x"], r["y"]) for r in matching.match_pairs(own, own).collect()]
    want = {}
    for x, y in pairs:
        n, shift = want.get((x // 100, y // 100), (0, 0))
        want[x // 100, y // 100] = (n + 1, shift + x - y)
    assert {(r["tx"], r["ty"]): (r["n"], r["shift"]) for r in matching.own_pair_sums(pieces, 4, 100, 611).collect()} == want
    for k, side in ((4, 400), (9, 70), (31, 70)):
        own, scale = sequence.words(pieces, k), TileScale.fit(side, 611, 611)
        met = {(r["x"] // scale.tile_w, r["y"] // scale.tile_h) for r in matching.match_pairs(own, own).collect()}
        black = [tuple(r) for r in matching.own_black_tiles(pieces, k, scale).collect()]
        assert set(black) == met and len(black) == len(met)


def test_black_tiles_of_a_sequence_are_painted_and_not_joined(spark, tables):
    black = queries.q_dotplot_black(spark, tables("A" * 20_000))
    assert not any("Join" in line and "kmer" in line for line in _plan(black).splitlines())
    docs = "ACGT" * 10 + "A" * 20_000 + "GATTACA" * 20_000
    tile, tiles = -(-len(docs) // queries.SIDE), {}
    for i in range(len(docs) - queries.K + 1):
        tiles.setdefault(docs[i : i + queries.K], set()).add(i // tile)
    want = {(x, y) for t in tiles.values() for x in t for y in t}
    assert {tuple(r) for r in black.collect()} == want and black.count() == len(want)


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_words_of_many_parts_are_counted_by_tile(monkeypatch, at_once):
    monkeypatch.setattr(matching, "PAIRED", 5)
    rows = [(kmer, (kmer * 37 + i * 13) % 90) for i in range(20) for kmer in (0, 4, 5, (1 << 62) - 1)]
    want, met = {}, set()
    for kmer, pos in rows:
        n, s = want.get((kmer, pos // 10), (0, 0))
        want[kmer, pos // 10] = (n + 1, s + pos)
    cut = [[np.array(c, np.int64) for c in zip(*[(k, p // 10, 1, p) for k, p in rows[a : a + at_once]], strict=True)] for a in range(0, len(rows), at_once)]
    names = ["kmer", "tile", "n", "s"]
    batches = [pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in c], names=names) for c in cut]
    kmer, t, n, s = (a.tolist() for a in sequence.whole_words(batches))
    assert list(zip(kmer, t, strict=True)) == sorted(want) and dict(zip(zip(kmer, t, strict=True), zip(n, s, strict=True), strict=True)) == want
    for i, j in matching._paired(np.array(kmer)):
        assert all(kmer[a] == kmer[b] for a, b in zip(i, j, strict=True))
        met |= {(kmer[a], t[a], t[b]) for a, b in zip(i, j, strict=True)}
    assert met == {(k, a, b) for k, a in want for m, b in want if k == m and a < b}
    two = sequence.whole_words(b.select(names[:2]) for b in batches)
    assert two[0].tolist() == kmer and two[1].tolist() == t and two[2] is None and two[3] is None
    assert [len(a) for a in sequence.whole_words([])] == [0, 0, 0, 0]


@pytest.mark.parametrize("name", ["q_dilate_color", "q_track_threshold", "q_meth_cells", "q_meth_colors", "q_meth_tiles"])
def test_tied_sites_follow_the_settled_sql(spark, tmp_path, name):
    """As above, for the queries made of the sites' tiles, and for sites above a threshold on either side of it."""
    test_sites_of_equal_offsets_that_the_sql_leaves_open(spark, tmp_path, name)
