import itertools
import json
import random
import struct
import threading
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom import api
from seqloom.__main__ import main
from seqloom.errors import ConfigError, InvalidInput, MalformedInput, MethylationError
from seqloom.functions import bases, color, regions, text
from seqloom.operators import kmer_index, matching, methylation, raster, runs, sequence
from seqloom.plans import durable, font, layout
from seqloom.plans.config import Config, load_json
from seqloom.plans.durable import join_small, materialise, release, scratch, shared_dir
from seqloom.plans.region import Region, parse_region
from seqloom.plans.scale import TileScale
from seqloom.sources import fasta, png, track

# ---- regions

REGIONS = {
    "chr1:100-500": ("id_slice", "chr1", 100, 500),
    "5-10": ("slice", None, 5, 10),
    "chrX": ("id", "chrX", None, None),
    "ref:part:10-20": ("id_slice", "ref:part", 10, 20),
    "ref:10-30:10-20": ("id_slice", "ref:10-30", 10, 20),
    "a:b": ("id", "a:b", None, None),
    "a:": ("id", "a:", None, None),
}
REGIONS |= {t: ("id", t, None, None) for t in ("chr1:500-100", "chr1:12-12", "chr1:abc-def", "chr1:10-20-30", "-", "-10", "10-", "-10-20", "10-20-30", "-10--10", "10--10", "id:-10", "id:10--10")}
REGIONS |= dict.fromkeys(("", ":", ":-", ":10-20", ":x"))


def test_region_grammar_in_python_and_columns(spark):
    rows = spark.createDataFrame([(t,) for t in REGIONS], "t string").select("t", regions.parse_region(F.col("t")).alias("r")).collect()
    for r in rows:
        want = REGIONS[r["t"]]
        got = parse_region(r["t"])
        assert (got and (got.kind, got.id, got.start, got.end)) == want, r["t"]
        assert (tuple(r["r"]) if r["r"] else None) == want, r["t"]


def test_region_labels():
    assert Region("c", 1000, 2_000_000).pretty() == "c:1,000-2,000,000" and Region("c", 1, 2).file_label() == "c_1-2"
    assert Region(None, 1, 2).pretty() == "1-2" and Region("c").file_label() == "c"
    for bad in ((None, 0, 0), ("", None, None), (None, None, None), ("a", 1, None)):
        with pytest.raises(InvalidInput):
            Region(*bad)


# ---- FASTA


def bases_of(seq):
    rows = sorted((r["pos"], r["bases"]) for r in seq.pieces.collect())
    out = ""
    for pos, part in rows:
        assert pos == len(out)
        out += part
    assert len(out) == seq.length
    return out


def order_of(seq):
    return [(r["id"], r["n"]) for r in seq.contigs.orderBy("ord").collect()]


THREE = ">a\nACGTACGTACCGT\n>b\nTTTTGGTTTTTTT\n>c\nGGG\n"
SET_B = ">a\nAAAAAA\n>b\nCCGGCCGG\n>c\nTTCCGGTT\n>d\nGGCCGGCCGG\n>e\nAAAACAAA\n"
FASTAS = [
    (THREE, "10-25", "CGTTTTTGGTTTTTT", [("a", 13), ("b", 13)]),
    (">a\nAAA\n>b\nCCC", "1-5", "AACC", [("a", 3), ("b", 3)]),
    ("\n>a\n\nAAA\n>b\nCCC\n\n>c\nGGG\n\n", "1-8", "AACCCGG", [("a", 3), ("b", 3), ("c", 3)]),
    (">a\nACGTACGT\n>b\nTTTT\n", "2-5", "GTA", [("a", 8)]),
    (">a\nAAA\n>b\nTTT\n>c\nGGG\n", "3-6", "TTT", [("a", 3), ("b", 3)]),
    (">a\nAA\nAA\n>b\nCC\nCC\n>c\nGGGG\n", "2-9", "AACCCCG", [("a", 4), ("b", 4), ("c", 4)]),
    (">a\nAAA\n>b\n>c\nCCC\n", "2-7", "ACCC", [("a", 3), ("b", 0), ("c", 3)]),
    (">a\nAAA\n>b\nTTATTTGG\n>c\nGGG\n", "b", "TTATTTGG", [("a", 3), ("b", 8)]),
    (">x\nAAA\n>y\nTTATTTGG\n>z\nGG\n", "y:2-5", "ATT", [("x", 3), ("y", 8)]),
    (">a one\naaa\r\n;note\n> b two\r\ntTnt\n>c\nGGG\n", None, "AAATTNTGGG", [("a", 3), ("b", 4), ("c", 3)]),
    ("AC\n>a\nGT\n", None, "ACGT", [("a", 4)]),
]


@pytest.mark.parametrize("data,region,want,order", FASTAS)
def test_fasta(spark, tmp_path, data, region, want, order):
    (tmp_path / "x.fa").write_text(data, newline="")
    seq = fasta.read_sequence(spark, str(tmp_path / "x.fa"), parse_region(region) if region else None)
    assert bases_of(seq) == want and order_of(seq) == order


def test_fasta_none_and_errors(spark, tmp_path):
    def read(data, region=None):
        (tmp_path / "x.fa").write_text(data)
        return fasta.read_sequence(spark, str(tmp_path / "x.fa"), region)

    assert read(">a\nAA\n>b\nTT\n", Region(None, 10, 12)) is None
    assert read(">a\n>b\n") is None and read(">a\nAA\n", Region("z")) is None and read(">a\nAA\n", Region("a", 1, 3)) is None
    for data, message in ((">a\nAAA\n>\nCC\n", "missing identifier"), ("", "no FASTA header"), (">a\nA-C\n", "gaps"), (">a\nA C\n", "invalid symbol")):
        with pytest.raises(MalformedInput, match=message):
            read(data)
    # what lies behind the region isn't looked at
    assert bases_of(read(">a\nAAA\n>b\nCC\n>c\nX\n", Region("b"))) == "CC"
    assert bases_of(read(">a\nAAA\n>b\nCC\n>c\nX\n", Region(None, 1, 4))) == "AAC"
    assert bases_of(fasta.read_sequence(spark, str(tmp_path / "x.fa"), Region("a"), preserve_case=True)) == "AAA"


def test_fasta_keeps_order_over_splits(spark, tmp_path):
    rng = random.Random(4)
    recs = [(f"r{i}", "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 400)))) for i in range(60)]
    lines = "".join(f">{i}\n" + "".join(s[k : k + 60] + "\n" for k in range(0, len(s), 60)) for i, s in recs)
    (tmp_path / "x.fasta").write_text(lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        seq = fasta.read_sequence(spark, str(tmp_path / "x.fasta"))
        assert fasta.read_lines(spark, str(tmp_path / "x.fasta")).select("split").distinct().count() > 3
        assert bases_of(seq) == "".join(s for _, s in recs) and order_of(seq) == [(i, len(s)) for i, s in recs]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# ---- sequences and matches


def pieces(spark, s, seed=0):
    rng, at, rows = random.Random(seed), 0, []
    while at < len(s):
        n = rng.randint(1, 9)
        rows.append((at, s[at : at + n]))
        at += n
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "pos long, bases string")


@settings(max_examples=15, deadline=None)
@given(st.text("ACGTN", min_size=1, max_size=80), st.integers(1, 12), st.integers(1, 13), st.integers(0, 99))
def test_kmers_slices_and_complements(spark, s, k, size, seed):
    p = pieces(spark, s, seed)
    got = sorted((r["pos"], r["kmer"]) for r in sequence.kmers(p, k, size=size).collect())
    assert got == [(i, s[i : i + k]) for i in range(len(s) - k + 1) if "N" not in s[i : i + k]]
    packed = sequence.packed_kmers(p, k, size=size).select("pos", bases.kmer_text(F.col("kmer"), k).alias("kmer"))
    assert sorted((r["pos"], r["kmer"]) for r in packed.collect()) == got
    turned = sequence.reverse_complement_pieces(p, len(s))
    want = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert "".join(r["bases"] for r in turned.orderBy("pos").collect()) == want
    assert "".join(r["bases"] for r in sequence.slice_pieces(p, k, k + size).orderBy("pos").collect()) == s[k : k + size]
    assert [r["pos"] for r in sequence.cytosine_positions(p).orderBy("pos").collect()] == [i for i, c in enumerate(s) if c == "C"]


def test_packed_words_of_all_lengths(spark):
    rng = random.Random(2)
    s = "".join(rng.choice("ACGTACGTACGTN") for _ in range(400)) + "T" * 40
    for k in (1, 2, 16, 30, 31, 32):
        got = sequence.words(pieces(spark, s), k)
        text = bases.kmer_text(F.col("kmer"), k) if k <= 31 else F.col("kmer")
        assert sorted(tuple(r) for r in got.select("pos", text).collect()) == [(i, s[i : i + k]) for i in range(len(s) - k + 1) if "N" not in s[i : i + k]]
    assert dict(sequence.words(pieces(spark, s), 5, upper=False).dtypes)["kmer"] == "string"
    with pytest.raises(Exception, match="upper-case"):
        sequence.packed_kmers(pieces(spark, "ACgT"), 2).collect()
    assert sequence.packed_kmers(pieces(spark, s).where("false"), 5).count() == 0


def test_matches_tiles_and_salts(spark):
    rng = random.Random(8)
    x, y = ("".join(rng.choice("AAAC") for _ in range(n)) for n in (300, 220))
    k, scale = 4, TileScale.fit(60, len(x), len(y))
    want = {}
    for i, j in itertools.product(range(len(x) - k + 1), range(len(y) - k + 1)):
        if x[i : i + k] == y[j : j + k]:
            t = (i // scale.tile_w, j // scale.tile_h)
            want[t] = want.get(t, 0) + 1
    kx, ky = sequence.kmers(pieces(spark, x), k), sequence.kmers(pieces(spark, y), k)
    for hits in (matching.tile_hits(kx, ky, scale), matching.tile_hits(kx, ky, scale, hot_tiles=3, salts=4), matching.raw_tile_hits(kx, ky, scale)):
        assert {(r["tx"], r["ty"]): r["hits"] for r in hits.collect()} == want


def test_hot_words_are_dealt_over_salts(spark):
    x, y = "ACGT" * 20 + "A" * 30, "A" * 40 + "ACGTACG"
    kx, ky = sequence.kmers(pieces(spark, x), 4), sequence.kmers(pieces(spark, y), 4)
    want = {(i, j) for i in range(len(x) - 3) for j in range(len(y) - 3) if x[i : i + 4] == y[j : j + 4]}
    for pairs in (matching.match_pairs(kx, ky), matching.match_pairs(kx, ky, hot_copies=3, salts=4)):
        found = [(r["x"], r["y"]) for r in pairs.collect()]
        assert set(found) == want and len(found) == len(want)
    few = {(r["x"], r["y"]) for r in matching.match_pairs(kx, ky, max_copies=20).collect()}
    assert few == {(i, j) for i, j in want if x[i : i + 4] != "AAAA"}


@pytest.mark.parametrize("band", [4096, 4, 1])
def test_maximal_matches_are_runs_of_words(spark, band):
    rng = random.Random(9)
    x, y = "".join(rng.choices("ACG", k=90)) + "ACGT" * 12, "".join(rng.choices("ACG", k=60)) + "CGTA" * 10
    y += x[10:40]
    pairs = matching.match_pairs(sequence.kmers(pieces(spark, x), 4), sequence.kmers(pieces(spark, y), 4))
    made = runs.maximal_matches(pairs, 4, band)
    want = set()
    for i in range(len(x)):
        for j in range(len(y)):
            n = 0
            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                n += 1
            if n >= 4 and not (i and j and x[i - 1] == y[j - 1]):
                want.add((i, j, n))
    found = [tuple(r) for r in made.collect()]
    assert len(found) == len(want) and set(found) == want
    words = [tuple(r) for r in runs.words_of_matches(made, 4).collect()]
    assert sorted(words) == sorted((r["x"], r["y"]) for r in pairs.collect())
    assert runs.maximal_matches(pairs.where("false"), 4).count() == 0


@pytest.mark.parametrize("hot", [10_000, 5])
def test_indexed_words_are_not_shuffled(spark, tmp_path, hot):
    rng = random.Random(10)
    x, y = "".join(rng.choices("ACGT", k=3000)) + "A" * 40, "".join(rng.choices("ACGT", k=900)) + "A" * 20
    xs, ys = sequence.words(pieces(spark, x), 6), sequence.words(pieces(spark, y), 6)
    want = sorted(map(tuple, matching.match_pairs(xs, ys).collect()))
    index = kmer_index.build(xs, str(tmp_path / "index"), 4, hot)
    again = kmer_index.open_index(spark, index.path, index.kind, index.buckets)
    assert spark.read.parquet(f"{index.path}/hot").count() == (0 if hot > 5 else sum(1 for i in range(len(x) - 5) if sum(x[i : i + 6] == x[j : j + 6] for j in range(len(x) - 5)) > 5))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for own in (index, again):
            found = kmer_index.probe(own, ys)
            assert sorted(map(tuple, found.collect())) == want
            plan = found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1] if hot > 5 else ""
            assert plan.count("Exchange hashpartitioning") <= 2 and "Bucketed: true" in plan or hot == 5
            kmer_index.forget(spark, own)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.read.parquet(f"{index.path}/words").count() > 0


def test_scopes_of_two_threads(spark):
    """A table that one thread makes isn't deleted with another's block."""
    made, opened, done = [], threading.Event(), threading.Event()

    def other():
        opened.wait(60)
        made.append(materialise(spark.range(5).toDF("i"), "other"))
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch(spark):
        own = materialise(spark.range(3).toDF("i"), "own")
        opened.set()
        assert done.wait(60) and own.count() == 3
    thread.join()
    assert made[0].count() == 5
    with pytest.raises(Exception, match="(?i)not.exist"):
        spark.read.parquet(durable._PATHS[own])


def test_offsets_of_rows_without_ord(spark):
    rows = [(1, "a", "ACG"), (None, "b", "AC"), (2, "c", "ACGT"), (None, "d", "A"), (None, None, "GG"), (None, "b", "AC"), (2, "c", "T"), (9, "e", "")]
    got = sequence.contigs_of(spark.createDataFrame(rows, "ord long, id string, seq string")).orderBy("off", "n").collect()
    assert len(got) == len(rows)
    at = 0
    for r in got:
        assert r["off"] == at
        at += r["n"]
    assert [r["ord"] for r in got if r["n"]][:3] == [1, 2, 2] and all(r["ord"] is None for r in got if r["off"] >= 8 and r["n"])


@pytest.mark.parametrize("kind", ["dense", "sparse", "one"])
def test_offsets_over_ranges(spark, monkeypatch, kind):
    """No task orders more than its range's rows, or a row for each range: also where ids are 64-bit hashes, or all equal."""
    rng = random.Random(6)
    ords = {"dense": range(3000), "sparse": sorted({rng.getrandbits(64) - (1 << 63) for _ in range(3000)}), "one": [7] * 3000}[kind]
    rows = [(o, i % 4 if kind != "one" else 2) for i, o in enumerate(ords)]
    kept = []
    monkeypatch.setattr(sequence, "materialise", lambda df, tag: kept.append(durable.materialise(df, tag)) or kept[-1])
    shuffled = rng.sample(rows, len(rows))
    got = sequence.with_offsets(spark.createDataFrame(shuffled, "ord long, n long")).orderBy("ord", "off").collect()
    assert [r["off"] for r in got] == [sum(n for _, n in rows[:i]) for i in range(len(rows))]
    sizes = [r["count"] for r in kept[0].groupBy("_range").count().collect()]
    assert 1 < len(sizes) <= 4 and max(sizes) < 1500


def test_tile_scale_known_values():
    assert TileScale.fit(4000, 30_000, 30_000) == TileScale(8, 8, 3750, 3750)
    assert TileScale.fit(4000, 50, 50) == TileScale(1, 1, 50, 50)
    assert TileScale.fit(400, 400, 1) == TileScale(1, 1, 400, 1)


# ---- tracks

BED = ["chr1", "100", "200", "m", "0", "+", "100", "200", "255,0,0", "5", "7.5"]


def parsed(spark, lines, fmt, chrom=None):
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    return [tuple(r)[1:] for r in track.parse_lines(df, fmt, chrom).orderBy("line_no").collect()]


def test_track_lines(spark):
    for fmt, fields in (("bed", BED), ("bedgraph", ["chr1", "100", "200", "0.5"])):
        names = track.COLUMNS[fmt]
        for i in range(1, len(fields)):
            assert parsed(spark, ["\t".join(fields[:i])], fmt)[0][-1] == f"missing {names[i]} column"
        assert parsed(spark, ["", "   "], fmt) == [(None, None, None, None, "missing Chrom column")] * 2
        for i, bad in ((1, "-1"), (1, "x"), (2, "1.5"), (len(fields) - 1, "nope"), (len(fields) - 1, "1.5f")):
            broken = fields[:i] + [bad] + fields[i + 1 :]
            assert parsed(spark, [" ".join(broken)], fmt)[0][-1] == f"invalid {names[i]} value"
        good = parsed(spark, ["  " + " \t ".join(fields) + "  extra"], fmt)[0]
        assert good == ("chr1", 100, 200, float(fields[-1]), None)
    assert parsed(spark, ["# c", "track x"], "bedgraph") == [("#", None, None, None, "invalid ChromStart value"), ("track", None, None, None, "invalid ChromStart value")]
    # rows of other chromosomes are dropped before their numbers are read
    assert [r[0] for r in parsed(spark, ["b x y z", "a 1 2 3"], "bedgraph", "a")] == ["a"]


def bed_file(tmp_path, rows, end=1):
    path = tmp_path / "t.bed"
    path.write_text("".join(f"{c}\t{s}\t{s + end}\tm\t0\t+\t{s}\t{s + end}\t255,0,0\t8\t{v}\t7\n" for c, s, v in rows))
    return str(path)


def sites_of(spark, path, contigs, region=None, threshold=0.0):
    table = spark.createDataFrame([(i, c, n, off) for i, (c, n, off) in enumerate(contigs)], "ord long, id string, n long, off long")
    found = methylation.read_sites(track.read_track(spark, path), table, region, threshold)
    return None if found is None else {r["pos"]: r["pct"] for r in found.collect()}


def test_track_pipelines(spark, tmp_path):
    rows = [("chrX", 0, 10), ("chr1", 0, 20), ("chrX", 1, 30), ("chr3", 1, 40), ("chr1", 1, 40)]
    two = [("chr1", 2, 0), ("chrX", 2, 2)]
    assert sites_of(spark, bed_file(tmp_path, rows), two) == {0: 20, 1: 40, 2: 10, 3: 30}
    assert sites_of(spark, bed_file(tmp_path, [("a", 0, 10), ("a", 1, 20), ("b", 0, 30), ("b", 1, 40)]), [("a", 2, 0), ("b", 2, 2)], Region(None, 1, 3)) == {0: 20, 1: 30}
    assert sites_of(spark, bed_file(tmp_path, [("b", 2, 20), ("a", 0, 10), ("b", 0, 2)]), [("a", 1, 0), ("b", 2, 1)], Region("b")) == {0: 2, 2: 20}
    assert sites_of(spark, bed_file(tmp_path, [("chr1", 0, 5), ("chr1", 1, 50)]), [("chr1", 2, 0)], threshold=10.0) == {1: 50}
    assert sites_of(spark, bed_file(tmp_path, [("c", 0, 0.25), ("c", 0, 0.5)]), [("c", 2, 0)]) == {0: 50}
    assert sites_of(spark, bed_file(tmp_path, [("a", 0, 5)]), [("c", 2, 0)], Region("c")) is None
    assert sites_of(spark, bed_file(tmp_path, [("a", 0, 5)]), [("c", 2, 0)]) == {}
    # a row of an unknown chromosome tells the scale without a region, not with one
    assert sites_of(spark, bed_file(tmp_path, [("c", 0, 1), ("z", 0, 50)]), [("c", 2, 0)]) == {0: 1}
    assert sites_of(spark, bed_file(tmp_path, [("c", 0, 1), ("z", 0, 50)]), [("c", 2, 0)], Region("c")) == {0: 100}
    # two contigs of one name: the first takes the sites, in a global interval the last
    same = [("c", 5, 0), ("c", 5, 5)]
    assert sites_of(spark, bed_file(tmp_path, [("c", 1, 5)]), same) == {1: 5} and sites_of(spark, bed_file(tmp_path, [("c", 1, 5)]), same, Region(None, 0, 10)) == {6: 5}
    for values, end in (([5], 2), ([101], 1), ([-1], 1), (["nan"], 1)):
        with pytest.raises(MethylationError):
            sites_of(spark, bed_file(tmp_path, [("c", 0, v) for v in values], end), [("c", 2, 0)])
    assert sites_of(spark, bed_file(tmp_path, [("c", 0, "nan"), ("c", 1, 50)]), [("c", 2, 0)]) == {1: 50}


SET_ROWS = [("b", 1, 10), ("b", 6, 12), ("c", 2, 20), ("c", 4, 25), ("d", 3, 30), ("e", 3, 99)]


@pytest.mark.parametrize(
    "data,rows,region,want,mismatch",
    [
        (">a\nACGTAC\n>b\n>c\nTTTTGG\n>d\nAAA\n", [("a", 1, 10), ("c", 3, 20), ("d", 0, 30)], None, {1: 10, 9: 20, 12: 30}, 9),
        (SET_B, SET_ROWS, "9-25", {3: 12, 7: 20, 9: 25}, 3),
        (SET_B, [*SET_ROWS, ("c", 7, 12)], "c:2-7", {0: 20, 2: 25}, 2),
        (SET_B.replace("TTCCGGTT", "TTCCCGTT"), [*SET_ROWS, ("c", 7, 12)], "c:2-7", {0: 20, 2: 25}, None),
    ],
)
def test_fasta_with_track(spark, tmp_path, data, rows, region, want, mismatch):
    (tmp_path / "x.fa").write_text(data)
    region = parse_region(region) if region else None
    seq = fasta.read_sequence(spark, str(tmp_path / "x.fa"), region)
    sites = methylation.read_sites(track.read_track(spark, bed_file(tmp_path, rows)), seq.contigs, region)
    assert {r["pos"]: r["pct"] for r in sites.collect()} == want
    string = bases_of(seq)
    kept = {r["pos"] for r in methylation.settle_mismatches(sites, seq.pieces).collect()}
    assert kept == {p for p in want if p < len(string) and string[p] == "C"}
    if mismatch is None:
        methylation.settle_mismatches(sites, seq.pieces, "error")
    else:
        with pytest.raises(MethylationError, match=f"position {mismatch} "):
            methylation.settle_mismatches(sites, seq.pieces, "error")


def test_cells_and_colours(spark):
    sites = spark.createDataFrame([(0, 10.0), (1, 20.0), (7, 90.0), (99, 5.0)], "pos long, pct float")
    xs = methylation.tile_stats(sites, 4, 5)
    got = {(r["tx"], r["ty"]): r["pct"] for r in methylation.cells(xs, xs, bands=3).collect()}
    assert got == {(0, 0): 15, (0, 1): 40, (1, 0): 40, (1, 1): 90}
    known = {0: (129, 155, 248), 10: (153, 146, 250), 20: (173, 137, 253), 30: (191, 127, 255), 40: (226, 127, 204), 50: (255, 127, 127), 100: (255, 127, 127), 150: (255, 127, 127)}
    rows = spark.createDataFrame([(float(p),) for p in known], "p float").select("p", color.colour(F.col("p")).alias("c")).collect()
    assert {r["p"]: tuple(r["c"]) for r in rows} == known
    assert all(tuple(png.legend_colour(p / 100)) == c for p, c in known.items())


# ---- rasters


def naive_colour(dots, r):
    out = dict(dots)
    for x, y in sorted(dots, key=lambda p: (p[1], p[0])):
        for dy, dx in itertools.product(range(r + 1), range(r + 1)):
            t = (x - dx, y - dy)
            if (dx, dy) != (0, 0) and min(t) >= 0:
                out[t] = tuple((a + b) >> 1 for a, b in zip(out[t], dots[x, y])) if t in out else dots[x, y]
    return out


def pixels(df):
    return {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in df.collect()}


@pytest.mark.parametrize("r", [0, 1, 2, 3])
def test_dilation_matches_in_place_loops(spark, r):
    rng = random.Random(r)
    dots = {(rng.randrange(12), rng.randrange(12)): tuple(rng.randrange(256) for _ in range(3)) for _ in range(25)}
    df = spark.createDataFrame([(*p, *c) for p, c in dots.items()], "x long, y long, r int, g int, b int")
    assert pixels(raster.dilate_colour(df, r)) == (naive_colour(dots, r) if r > 1 else dots)
    black = {(r_["x"], r_["y"]) for r_ in raster.dilate_black(df, r).collect()}
    assert black == {(x - a, y - b) for x, y in dots for a in range(r + 1 if r > 1 else 1) for b in range(r + 1 if r > 1 else 1) if x >= a and y >= b}
    both = pixels(raster.composite(df, df.where("r > 128")))
    assert both == {p: (0, 0, 0) if c[0] > 128 else c for p, c in dots.items()}


def test_enlarge_takes_nearest(spark):
    dots = {(x, y): (x * 20, y * 30, 7) for x in range(5) for y in range(3)}
    df = spark.createDataFrame([(*p, *c) for p, c in dots.items()], "x long, y long, r int, g int, b int")
    big, w, h = raster.enlarge(df, 5, 3, 17)
    assert (w, h) == (17, 10)
    assert pixels(big) == {(x, y): dots[int((x + 0.5) * 5 / 17), int((y + 0.5) * 3 / 10)] for x in range(17) for y in range(10)}


# ---- labels and configuration


def test_text_functions(spark):
    durations = {0: "< 1 ns", 999: "999 ns", 1000: "1 μs", 1010: "1.01 μs", 1100: "1.1 μs", 1234: "1.23 μs", 12345: "12.34 μs", 1234567: "1.23 ms", 12345678123: "12.34 s", 12345678123456: "12,345.67 s"}
    rows = spark.createDataFrame([(n,) for n in durations], "n long").select("n", text.duration(F.col("n")).alias("t")).collect()
    assert {r["n"]: r["t"] for r in rows} == durations
    cut = [("abcdef", 6, "abcdef"), ("abcdef", 3, "abc"), ("abcdef", 2, "ab"), ("abcdefgh", 6, "abc...")]
    for value, size, want in cut:
        assert spark.range(1).select(text.truncate(F.lit(value), size)).first()[0] == want == layout.truncated(value, size)
    assert spark.range(1).select(text.truncate(F.lit("abcdefgh"), 6, False)).first()[0] == "abcdef..."
    bad = spark.createDataFrame([("ACgtN",), ("AC-",), ("",)], "s string").select(bases.is_valid(F.col("s")), bases.first_offender(F.col("s"))).collect()
    assert [tuple(r) for r in bad] == [(True, ""), (False, "-"), (True, "")]


def test_ticks_and_layout():
    assert layout.vertical_ticks(103, 50) == [(0, 0), (20, 10), (40, 20), (60, 30), (80, 40), (103, 50)]
    assert layout.horizontal_ticks(9, 9) == [(0, 0), (3, 3), (6, 6), (9, 9), (9, 9)]
    assert [layout.tick_count(n) for n in (100, 5, 8, 9, 2, 7)] == [6, 6, 5, 4, 3, 2]
    assert layout.vertical_ticks(100, 50, 1000)[1] == (1020, 10) and layout.horizontal_ticks(9, 9, 7)[-2:] == [(16, 9), (16, 9)]
    page = layout.arrange(4000, 3750, 3750, 3)
    assert (page.titles_at[1], page.text, page.border) == (400, 80, 12) and page.legend[2:] == (480, 3000)
    x, y, w, h = page.plot
    assert (w, h) == (3750, 3750) and 2 * x + w + 480 == page.canvas[0]
    axes = layout.AxisInfo(layout.axis_label("c:1-30,001", True), 0, 30_000), layout.AxisInfo("c", 5, 30_000)
    boxes = layout.black_boxes(page, ["one", "", "two"], *axes, 30.0)
    assert all(a >= 0 and b >= 0 and c > 0 and d > 0 and a + c <= page.canvas[0] and b + d <= page.canvas[1] for a, b, c, d in boxes)


def drawn(boxes):
    return {(x + i, y + j) for x, y, w, h in boxes for i in range(w) for j in range(h)}


def test_font_turns_and_scales():
    flat = drawn(font.text_boxes("L1é", 0, 0, 1))
    assert {(0, y) for y in range(7)} | {(x, 6) for x in range(5)} == {p for p in flat if p[0] < 6}
    assert drawn(font.text_boxes("L1é", 0, 0, 1, "right")) == {(7 - y, x) for x, y in flat}
    assert drawn(font.text_boxes("L1é", 0, 0, 1, "left")) == {(y, 17 - x) for x, y in flat}
    assert drawn(font.text_boxes("L1é", 5, 3, 2)) == {(5 + 2 * x + i, 3 + 2 * y + j) for x, y in flat for i in range(2) for j in range(2)}
    assert len(font.COLUMNS) == 95 and len({c for c in font.COLUMNS}) == 95
    assert not font.text_boxes(" ", 0, 0, 3) and font.text_boxes("ñ", 0, 0, 1) == font.text_boxes("ü", 0, 0, 1)


def test_config(tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"sequence": "a.fa", "word_length": 5, "fst_rev": True}))
    merged = load_json(str(file)).merged(Config(word_length=7, region="x:1-2")).checked()
    assert (merged.word_length, merged.fst_rev, merged.plot_side, merged.regions()[1]) == (7, True, 4000, Region("x", 1, 2))
    file.write_text('{"word-length": 5}')
    with pytest.raises(ConfigError):
        load_json(str(file))
    for bad in ({}, {"sequence": "a", "fst_sequence": "b"}, {"fst_sequence": "b"}, {"sequence": "a", "region": "x", "fst_region": "y"}, {"sequence": "a", "methylation": "m", "fst_methylation": "n"}, {"fst_sequence": "a", "snd_sequence": "b", "fst_methylation": "n"}):
        with pytest.raises(ConfigError):
            Config(**bad).checked()
    for bad in ({"methylation_threshold": 101.0}, {"plot_side": 349}, {"plot_side": 12_501}, {"word_length": 0}, {"region": ":1-2"}, {"on_mismatch": "x"}, {"fst_methylation": "a", "snd_methylation": "b"}):
        with pytest.raises(InvalidInput):
            Config(sequence="a", **bad).checked()
    with pytest.raises(InvalidInput):
        fasta.check_extension("x.txt", fasta.EXTENSIONS)
    assert fasta.check_extension("d/x.FNA", fasta.EXTENSIONS) == "fna"


# ---- whole plots


def read_png(path):
    data = open(path, "rb").read()
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, packed, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        size = struct.unpack(">II", body[:8]) if kind == b"IHDR" else size
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, (w, h) = zlib.decompress(packed), size
    return w, h, [raw[y * (3 * w + 1) + 1 : (y + 1) * (3 * w + 1)] for y in range(h)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=2000), min_size=1, max_size=6))
def test_checksums_of_bands_are_joined(parts):
    check = 1
    for part in parts:
        check = png.joined_check(check, zlib.adler32(part), len(part))
    assert check == zlib.adler32(b"".join(parts))


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_bands_are_one_image(spark, tmp_path, rows):
    rng = random.Random(3)
    page = layout.arrange(400, 300, 200, 2)
    dots = {(rng.randrange(300), rng.randrange(200)): tuple(rng.randrange(255) for _ in "rgb") for _ in range(900)}
    df = spark.createDataFrame([(*at, *c) for at, c in dots.items()], "x long, y long, r int, g int, b int")
    boxes = layout.black_boxes(page, ["a", "b"], layout.AxisInfo("x", 0, 300), layout.AxisInfo("y", 0, 200), 30.0)
    path = str(tmp_path / "x.png")
    png.write_png(png.packed_bands(df, page, boxes, rows), *page.canvas, path, {"Title": "t"})
    image = zlib.decompress(b"".join(png_parts(path)))
    stride = 1 + 3 * page.canvas[0]
    assert len(image) == stride * page.canvas[1]
    black = {(i, j) for x, y, w, h in boxes for i in range(x, x + w) for j in range(y, y + h)}
    for (x, y), colour in dots.items():
        at = (x + page.plot[0], y + page.plot[1])
        assert at in black or tuple(image[at[1] * stride + 1 + 3 * at[0] :][:3]) == colour
    for x, y in rng.sample(sorted(black), 300):
        assert image[y * stride + 1 + 3 * x :][:3] == b"\0\0\0"


def png_parts(path):
    with open(path, "rb") as f:
        raw = f.read()
    at = 8
    while at < len(raw):
        (n,) = struct.unpack(">I", raw[at : at + 4])
        if raw[at + 4 : at + 8] == b"IDAT":
            yield raw[at + 8 : at + 8 + n]
        at += 12 + n


@pytest.mark.parametrize("r", [2, 3, 5])
def test_dots_grow_over_tiles_borders(spark, r):
    rng = random.Random(r)
    dots = {(rng.randrange(40), rng.randrange(40)): tuple(rng.randrange(256) for _ in "rgb") for _ in range(200)}
    df = spark.createDataFrame([(*at, *c) for at, c in dots.items()], "x long, y long, r int, g int, b int")
    assert pixels(raster.dilate_colour(df, r, 8)) == naive_colour(dots, r)
    assert {(p["x"], p["y"]) for p in raster.dilate_black(df, r, 8).collect()} == {(x - i, y - j) for x, y in dots for i in range(r + 1) for j in range(r + 1) if x >= i and y >= j}


def test_render_single_and_cli(spark, tmp_path, capsys):
    rng = random.Random(1)
    s = "".join(rng.choice("ACGT") for _ in range(120))
    (tmp_path / "x.fa").write_text(f">c\n{s}\n")
    cs = [i for i, b in enumerate(s) if b == "C"][:5]
    bed = bed_file(tmp_path, [("c", i, 60) for i in [*cs, s.index("A")]])
    args = ["plot", "--sequence", str(tmp_path / "x.fa"), "--methylation", bed, "-w", "8", "--plot-side", "350", "-o", str(tmp_path / "out"), "--enlarge-small"]
    assert main(args) == 0
    path = capsys.readouterr().out.strip()
    assert path.endswith("/c__c.png")
    notes = json.load(open(path.replace(".png", ".json")))
    w, h, rows = read_png(path)
    assert [w, h] == notes["canvas"] and notes["titles"][0] == "FASTA (x.fa) vs. FASTA (x.fa)" and "enlarged" in notes["titles"][-1]
    x0, y0 = notes["origin"]
    # the first title stands in the upper left corner, in the image's own font
    page = layout.arrange(350, *[350] * 2, len(notes["titles"]))
    title = drawn(font.text_boxes(notes["titles"][0], *page.titles_at, page.scale))
    for tx, ty in itertools.product(range(page.titles_at[0], page.titles_at[0] + page.width_of(notes["titles"][0])), range(page.titles_at[1], page.titles_at[1] + 8)):
        assert (rows[ty][3 * tx] == 0) == ((tx, ty) in title)
    assert notes["removed_sites"] == [1, 1]
    for i in (0, 50, 100):  # the diagonal is black
        at = int((i + 0.5) * 350 / 120)
        assert rows[y0 + at][3 * (x0 + at) : 3 * (x0 + at) + 3] == b"\x00\x00\x00"
    assert main(args) == 0 and capsys.readouterr().out.strip() != path
    assert main(["plot", "--sequence", str(tmp_path / "x.fa"), "-w", "999"]) == 1


def test_pairwise_strands_and_sites(spark, tmp_path):
    s = "ACGTTGCAACCGGTTAACGCGT"
    turned = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    (tmp_path / "x.fa").write_text(f">c\n{s}\n")
    (tmp_path / "y.fa").write_text(f">d\n{turned}\n")
    seen = api.load(spark, Config(sequence=str(tmp_path / "x.fa"), region="c:2-12", fst_rev=True, word_length=3)).axes()
    assert (seen[0].label, seen[1].label) == ("c:2-12 (rev. comp.)", "c:2-12") and [(a.start, a.length) for a in seen] == [(0, 10)] * 2
    plot = api.load(spark, Config(fst_sequence=str(tmp_path / "x.fa"), snd_sequence=str(tmp_path / "y.fa"), snd_rev=True, word_length=10))
    assert {(r["x"], r["y"]) for r in plot.matches().collect()} == {(i, i) for i in range(len(s) - 9)}
    bed = bed_file(tmp_path, [("c", 1, 60), ("c", 0, 60)])
    both = api.load(spark, Config(sequence=str(tmp_path / "x.fa"), methylation=bed, snd_rev=True, word_length=5))
    assert [r["pos"] for r in both.x_sites.collect()] == [1] and [r["pos"] for r in both.y_sites.collect()] == [len(s) - 2]
    assert {(r["tx"], r["ty"]) for r in both.cells().collect()} == {(1, len(s) - 2)}
    with pytest.raises(InvalidInput):
        api.load(spark, Config(sequence=str(tmp_path / "x.fa"), region="z"))


def test_track_stream(spark, tmp_path):
    from seqloom.streaming import track_stream

    folder, seen = tmp_path / "in", {}
    folder.mkdir()
    (folder / "a.bedgraph").write_text("c 1 2 5\nc 1 2 7\nd 3 4 9\n")
    keep = lambda df, _: seen.update({(r["chrom"], r["start"]): r["pct"] for r in df.collect()})
    for later in (None, "c 1 2 8\n"):
        if later:
            (folder / "b.bedgraph").write_text(later)
        track_stream.start(spark, str(folder), "bedgraph", str(tmp_path / "state"), keep).awaitTermination()
    assert seen == {("c", 1): 8.0, ("d", 3): 9.0}
    # malformed lines are told, or end the query
    bad, told = tmp_path / "bad", []
    bad.mkdir()
    (bad / "a.bedgraph").write_text("c 1 2 5\nc 1 x 7\n\n")
    tell = lambda df, _: told.extend(sorted(r["problem"] for r in df.collect()))
    track_stream.start(spark, str(bad), "bedgraph", str(tmp_path / "state2"), keep, tell).awaitTermination()
    assert told == ["invalid ChromEnd value", "missing Chrom column"] and seen["c", 1] == 5.0
    with pytest.raises(Exception, match="invalid ChromEnd value"):
        track_stream.start(spark, str(bad), "bedgraph", str(tmp_path / "state3"), keep).awaitTermination()


def test_further_track_formats(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(track.FORMATS, "wig4", None)
    track.register_format("wig4", track.LineFormat(("Chrom", "From", "To", "Kind", "Level")))
    (tmp_path / "t.wig4").write_text("c 1 2 x 50\n")
    assert [tuple(r)[1:] for r in track.read_track(spark, str(tmp_path / "t.wig4")).collect()] == [("c", 1, 2, 50.0)]
    with pytest.raises(InvalidInput):
        track.register_format("no", track.LineFormat(("a", "b", "c")))


def test_scratch_keeps_what_is_kept(spark):
    with scratch(spark) as own:
        a, b = materialise(spark.range(3), "a"), materialise(spark.range(4), "b")
        with scratch(spark) as inner:
            c, d = materialise(spark.range(5), "c"), materialise(spark.range(6), "d")
            inner.keep(c)
        own.keep(b, c)
    assert b.count() == 4 and c.count() == 5
    for gone in (a, d):
        with pytest.raises(Exception):
            gone.count()
    with pytest.raises(ZeroDivisionError), scratch(spark):
        e = materialise(spark.range(3), "e")
        1 / 0
    with pytest.raises(Exception):
        e.count()


def test_clusters_need_a_shared_folder(spark):
    class Cluster:
        conf = {}  # names no folder
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "x"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_durable_helpers(spark):
    empty = spark.createDataFrame([], "a long, b string")
    kept = materialise(empty, "t")
    assert kept.schema == empty.schema and kept.count() == 0
    assert release(spark) >= 1 and release(spark) == 0
    big = spark.createDataFrame([(i, None if i % 3 == 0 else "k%d" % (i % 2)) for i in range(20)], "a long, k string")
    small = materialise(spark.createDataFrame([(None, 1), ("k0", 2)], "k string, v int"), "t")
    want = sorted((i, None if i % 3 == 0 else "k%d" % (i % 2), 1 if i % 3 == 0 else 2 if i % 2 == 0 else 0) for i in range(20))
    for limit in (100, 0):
        got = join_small(big, small, ["k"], F.col("a"), max_rows=limit).select("a", "k", F.coalesce("v", F.lit(0))).collect()
        assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
