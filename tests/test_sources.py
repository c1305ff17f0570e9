"""Offset and block indexes, and the tracks' data source."""

import gzip
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from seqloom.errors import MalformedInput
from seqloom.plans.region import Region
from seqloom.sources import bgzf, byte_ranges, fasta, fasta_index, track, track_index, track_source


def bases_of(found):
    return None if found is None else ("".join(r["bases"] for r in found.pieces.orderBy("pos").collect()), found.length, found.multi, found.label, [tuple(r) for r in found.contigs.select("ord", "id", "n", "off").orderBy("ord").collect()])


def fasta_text(rng, feed, lower=False):
    out = ["; first comment", ""]
    for i in range(12):
        out.append(f">r{i % 10} of test")
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 7, 8, 64, 333])))
        if i == 5:
            out.append(";between")
        out += [(x.lower() if i % 2 else x) for x in (seq[k : k + 8] for k in range(0, len(seq), 8))]
        if i == 7 and len(seq) > 20:
            out[-3:-2] = [out[-3][:3], out[-3][3:], ""]  # uneven lines
        if i % 3 == 0:
            out.append("")
    return feed.join(out) + rng.choice(["", feed])


@pytest.mark.parametrize(("feed", "seed"), [("\n", 1), ("\r\n", 2)])
def test_indexed_regions_equal_the_scan(spark, tmp_path, monkeypatch, feed, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(fasta_index, "CHUNK", 24)
    path, index = str(tmp_path / "x.fa"), str(tmp_path / "index")
    with open(path, "w", newline="") as f:
        f.write(fasta_text(rng, feed))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        fasta_index.write_index(spark, path, index)
        total = spark.read.parquet(f"{index}/records").agg(F.sum("n")).first()[0]
        regions = [Region("r0"), Region("r8", 2, 5), Region("none"), Region("r1", 0, 10**6), Region("r5"), Region("r7"), Region(None, 3, 40), Region(None, total - 9, total + 50), Region(None, total + 1, total + 5)]
        for region in regions:
            assert bases_of(fasta_index.read_indexed(spark, path, index, region)) == bases_of(fasta.read_sequence(spark, path, region)), region
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_region_reads_its_bytes_only(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    path, index = str(tmp_path / "x.fa"), str(tmp_path / "index")
    seqs = {"a": 40_000, "b": 1_000_000, "c": 9}
    text = {k: "".join(rng.choices("ACGT", k=n)) for k, n in seqs.items()}
    with open(path, "w") as f:
        for k, seq in text.items():
            f.write(f">{k}\n" + "\n".join(seq[i : i + 70] for i in range(0, len(seq), 70)) + "\n")
    fasta_index.write_index(spark, path, index)
    assert [r["even"] for r in spark.read.parquet(f"{index}/records").collect()] == [True] * 3
    monkeypatch.setattr(fasta_index, "read_sequence", lambda *a: 1 / 0)  # no scan
    found = fasta_index.read_indexed(spark, path, index, Region("b", 500_000, 530_000))
    assert bases_of(found)[0] == text["b"][500_000:530_000]
    contigs = spark.read.parquet(f"{index}/records")
    ranges = fasta_index.region_ranges(contigs, 540_000, 570_000, 4096)
    size, longest, n = ranges.agg(F.sum(F.col("stop") - F.col("start")), F.max(F.col("stop") - F.col("start")), F.count("*")).first()
    assert 30_000 <= size <= 30_000 * 71 / 70 + 2 * n and longest <= 4096 and n >= 7
    assert bases_of(fasta_index.read_indexed(spark, path, index, Region(None, 39_990, 40_010)))[0] == (text["a"] + text["b"])[39_990:40_010]


def test_folders_and_changed_files(spark, tmp_path):
    folder, index = tmp_path / "many", str(tmp_path / "index")
    folder.mkdir()
    (folder / "1.fa").write_text(">x\nACGT\nAC\n")
    (folder / "2.fa").write_text(">y\nTTTT\nGG")
    fasta_index.write_index(spark, str(folder), index)
    assert bases_of(fasta_index.read_indexed(spark, str(folder), index, Region(None, 3, 9)))[0] == "TACTTT" == bases_of(fasta.read_sequence(spark, str(folder), Region(None, 3, 9)))[0]
    (folder / "2.fa").write_text(">y\nTTTTT\nGGCC")
    assert bases_of(fasta_index.read_indexed(spark, str(folder), index, Region("y")))[0] == "TTTTTGGCC"
    (folder / "1.fa").write_text(">x\nAC-T\nAC\n")
    fasta_index.write_index(spark, str(folder), index)
    assert bases_of(fasta_index.read_indexed(spark, str(folder), index, Region("y")))[0] == "TTTTTGGCC"
    with pytest.raises(MalformedInput):
        fasta_index.read_indexed(spark, str(folder), index, Region("x"))


def bed_line(chrom, start, value, sep="\t"):
    return sep.join([chrom, str(start), str(start + 1), "m", "0", "+", "0", "1", "0,0,0", "9", str(value)])


def rows_of(df):
    return [tuple(r) for r in df.select("chrom", "start", "end", F.col("value").cast("double")).collect()]


@pytest.mark.parametrize("ordered", [True, False])
def test_track_regions_equal_the_scan(spark, tmp_path, ordered):
    rng = random.Random(3)
    rows = [(f"chr{rng.randrange(4)}", rng.randrange(3000), round(rng.random() * 100, 2)) for _ in range(1500)]
    rows = sorted(rows) if ordered else rows
    path, index = str(tmp_path / "x.bed"), str(tmp_path / "index")
    with open(path, "w", newline="") as f:
        f.write("\r\n".join(bed_line(*r) for r in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        track_index.write_index(spark, path, index, block=2000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    blocks = spark.read.parquet(f"{index}/blocks")
    assert track_index.is_sorted(blocks) == ordered and blocks.agg(F.sum("lines")).first()[0] == len(rows)
    for chrom, start, end in (("chr1", 500, 800), ("chr2", None, None), ("chr0", 2999, None), ("none", 1, 2), ("chr3", None, 10)):
        got = track_index.read_region(spark, path, index, chrom, start, end)
        want = track.read_track(spark, path, chrom).where((F.col("start") >= (start or 0)) & (F.col("start") < (end or 10**9)))
        assert rows_of(got.orderBy("line_no")) == rows_of(want.orderBy("line_no"))
    read = track_index.region_ranges(blocks, "chr1", 500, 800).agg(F.sum(F.col("stop") - F.col("start"))).first()[0]
    assert read < os.path.getsize(path) / (20 if ordered else 1)
    with open(path, "a") as f:
        f.write("\r\n" + bed_line("chr1", 600, 5))
    assert ("chr1", 600, 601, 5.0) in rows_of(track_index.read_region(spark, path, index, "chr1", 500, 800))
    with open(path, "a") as f:
        f.write("\nbad")
    with pytest.raises(MalformedInput):
        track_index.write_index(spark, path, index)


LINES = [" chr1\t5 6  12.5 ", "chr2 +7 8 .5e1 more", "chr1 9223372036854775807 8 nan", "chr3 000000000000000000000012 13 1.", "chr1 1 2 -inf", "chr4 1 2 1e60", "chr1 3 4 +7"]


@pytest.mark.parametrize("split", [1, 3, 20, 10_000])
def test_source_reads_as_read_track(spark, tmp_path, split):
    track_source.register(spark)
    path = str(tmp_path / "x.bedgraph")
    for text in ("\n".join(LINES), "\r\n".join(LINES) + "\r\n"):
        with open(path, "w", newline="") as f:
            f.write(text)
        read = spark.read.format("bedgraph").option("split_bytes", split)
        assert sorted(map(repr, rows_of(read.load(path)))) == sorted(map(repr, rows_of(track.read_track(spark, path))))
        assert sorted(map(repr, rows_of(read.load("file://" + path).where("chrom = 'chr1' AND start >= 3 AND start < 6")))) == sorted(map(repr, [("chr1", 5, 6, 12.5), ("chr1", 3, 4, 7.0)]))


@pytest.mark.parametrize(("line", "said"), [("", "missing Chrom column"), ("a", "missing ChromStart column"), ("a x 2 3", "invalid ChromStart value"), ("a 1 -2 3", "invalid ChromEnd value"), ("a 1 2", "missing DataValue column"), ("a 1 2 1.5f", "invalid DataValue value"), ("a 9223372036854775808 2 3", "invalid ChromStart value")])
def test_source_tells_malformed_lines(spark, tmp_path, line, said):
    track_source.register(spark)
    path = tmp_path / "x.bedgraph"
    path.write_text("\n".join(["b 1 2 3", line, "b x"]))
    with pytest.raises(MalformedInput, match=said):
        track.read_track(spark, str(path))
    with pytest.raises(Exception, match=said):
        spark.read.format("bedgraph").load(str(path)).collect()
    if line:
        other = spark.read.format("bedgraph").load(str(path)).where("chrom = 'c'")
        assert other.count() == 0 and track.read_track(spark, str(path), "c").count() == 0


def test_source_pushes_filters(spark, tmp_path, capsys):
    track_source.register(spark)
    (tmp_path / "x.bed").write_text("\n".join(bed_line(f"chr{i % 3}", i, i) for i in range(50)))
    kept = spark.read.format("bedmethyl").load(str(tmp_path)).where("chrom IN ('chr1', 'chr2') AND start > 10 AND start <= 20 AND value < 18")
    assert sorted(r["start"] for r in kept.collect()) == [11, 13, 14, 16, 17]
    kept.explain(True)
    physical = capsys.readouterr().out.split("== Physical Plan ==")[1]
    left = [x for x in physical.splitlines() if "Filter" in x]
    assert "value" in left[0] and "start#" not in left[0].split("isnotnull(start")[-1].replace(")", "", 1) or "> 10" not in left[0]
    assert "> 10" not in left[0] and "IN" not in left[0]
    reader = track_source.TrackReader(str(tmp_path), "bed", 64)
    assert len(reader.partitions()) > 10


def block_gzip(raw, rng, most):
    """``raw`` as BGZF, in blocks of random sizes, with the empty block at the end."""
    out, at, places = b"", 0, []
    while at < len(raw):
        n = rng.randint(1, most)
        part, at = raw[at : at + n], at + n
        pack = zlib.compressobj(6, wbits=-15)
        data = pack.compress(part) + pack.flush()
        places.append(len(out))
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(part), len(part))
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"), places


def test_ranges_of_block_gzip_hold_each_line_once(tmp_path):
    rng = random.Random(12)
    for most in (3, 40, 3000):
        raw = b"\n".join(bytes(rng.choice(b"abc \x1f\x8b\x08\x04") for _ in range(rng.choice([0, 1, 5, 90, 700]))) for _ in range(60)) + rng.choice([b"", b"\n"])
        data, _ = block_gzip(raw, rng, most)
        path = tmp_path / f"{most}.gz"
        path.write_bytes(data)
        assert gzip.decompress(data) == raw and bgzf.is_bgzf("file://" + str(path))
        for split in (7, 100, 5000, len(data)):
            with byte_ranges.opened("file://" + str(path)) as handle:
                got = [x for start in range(0, len(data), split) for lines in bgzf.lines_of_range(handle, start, min(start + split, len(data)), len(data)) for x in lines]
            want = raw.split(b"\n")
            assert got == (want[:-1] if want[-1] == b"" else want), (most, split)


def test_block_gzip_is_read_as_the_plain_file(spark, tmp_path, monkeypatch):
    rng = random.Random(13)
    text = "\r\n".join(bed_line(f"chr{rng.randrange(3)}", i, i % 101) for i in range(900))
    (tmp_path / "x.bed").write_text(text)
    (tmp_path / "x.bed.gz").write_bytes(block_gzip(text.encode(), rng, 2000)[0])
    (tmp_path / "y.bed.gz").write_bytes(gzip.compress(text.encode()))
    plain = rows_of(track.read_track(spark, str(tmp_path / "x.bed")))
    real = bgzf.raw_lines
    monkeypatch.setattr(bgzf, "raw_lines", lambda spark, path: real(spark, path, 700))
    lines = fasta.read_lines(spark, str(tmp_path / "x.bed.gz"))
    assert lines.select("split").distinct().count() > 5
    for name in ("x.bed.gz", "y.bed.gz"):
        assert sorted(rows_of(track.read_track(spark, str(tmp_path / name)))) == sorted(plain)
    fa = ">a\n" + "\n".join("ACGT" * 10 for _ in range(200)) + "\n>b\nAC"
    (tmp_path / "x.fa.gz").write_bytes(block_gzip(fa.encode(), rng, 500)[0])
    assert bases_of(fasta.read_sequence(spark, str(tmp_path / "x.fa.gz")))[0] == "ACGT" * 2000 + "AC"
    damaged = bytearray(block_gzip(text.encode(), rng, 2000)[0])
    damaged[40] ^= 1
    (tmp_path / "z.bed.gz").write_bytes(damaged)
    with pytest.raises(Exception, match="damaged|invalid|Error"):
        track.read_track(spark, str(tmp_path / "z.bed.gz")).collect()


def test_ranges_of_lines(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_bytes("é\nb\r\n\nlast".encode())
    placed = byte_ranges.placed(byte_ranges.raw_lines(spark, str(path))).orderBy("at").collect()
    assert [(r["at"], r["bytes"]) for r in placed] == [(0, 3), (3, 3), (6, 1), (7, 5)]
    file = placed[0]["split"]["file"]
    ranges = spark.createDataFrame([(file, 3, 7), (file, 7, 11)], "file string, start long, stop long")
    assert sorted(tuple(r)[1:] for r in byte_ranges.lines_of_ranges(ranges).collect()) == [(3, "b"), (6, ""), (7, "last")]
    assert not byte_ranges.readable("viewfs://store/x") and byte_ranges.readable(file)
