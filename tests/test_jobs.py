import json
import os
import random
import subprocess
import sys

import duckdb
import pytest

from jobs import panel_screen, queries, track_tiles
from jobs.common import load_config, read_if_there
from seqloom.errors import ConfigError

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
K = 5


def letters(rng, n):
    return "".join(rng.choice("acgtACGT -xz") for _ in range(n))


def turned(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def screened(records, panel, k):
    """{(record, item, strand): (matches, covered, first, last)}"""
    clean = lambda t: "".join(c for c in (t or "").upper() if c in "ACGT")
    words = {}
    for item, text in panel:
        if item is not None:
            for strand, seq in (("+", clean(text)), ("-", turned(clean(text)))):
                for i in range(len(seq) - k + 1):
                    words.setdefault(seq[i : i + k], set()).add((item, strand))
    found = {}
    for record, text in records:
        seq = clean(text)
        for i in range(len(seq) - k + 1):
            for own in words.get(seq[i : i + k], ()):
                found.setdefault((record, *own), set()).add(i)
    return {key: (len(at), len({b for i in at for b in range(i, i + k)}), min(at), max(at)) for key, at in found.items()}


def hits(spark, out):
    return {tuple(r)[:3]: tuple(r)[3:7] for r in read_if_there(spark, out, panel_screen.HITS).collect()}


def save(spark, path, rows, schema, mode="append"):
    spark.createDataFrame(rows, schema).repartition(2).write.mode(mode).parquet(str(path))


@pytest.fixture
def growing(spark, tmp_path):
    rng = random.Random(8)
    panel = [(i, letters(rng, 60)) for i in range(6)] + [(6, None), (None, "acgtacgtacgt"), (7, "acg")]
    records = [(i, letters(rng, rng.randrange(0, 300))) for i in range(10)]
    records += [(10, panel[0][1] * 60), (11, ""), (12, None), (12, panel[1][1]), (12, panel[2][1])]
    later = [(i, letters(rng, 200) + panel[3][1]) for i in range(13, 18)] + [(40, turned("".join(c for c in panel[4][1].upper() if c in "ACGT")))]
    save(spark, tmp_path / "panel", [(i, t, "k", 1) for i, t in panel], "item_id long, text string, kmer string, pos int")
    return tmp_path, panel, records, later


def test_screen_takes_only_what_is_new(spark, growing, monkeypatch):
    folder, panel, records, later = growing
    monkeypatch.setattr(panel_screen, "SPAN", 7)
    config = panel_screen.Config(word_length=K)
    schema = "doc_id long, text string, batch string, record int"
    paths = [str(folder / n) for n in ("records", "panel", "out", "state")]
    wide = lambda rows: [(i, t, "b", 1) for i, t in rows]
    save(spark, paths[0], wide(records) + [(None, "acgtacgt", "b", 1)], schema)
    told = panel_screen.run(spark, *paths, config)
    assert (told["batch"], told["records"], told["high"], told["without_id"]) == ("start", len(records), 12, 1)
    assert hits(spark, paths[2]) == screened(records, panel, K) and told["hits"] == len(hits(spark, paths[2]))
    again = panel_screen.run(spark, *paths, config)
    assert (again["records"], again["hits"]) == (0, 0) and hits(spark, paths[2]) == screened(records, panel, K)
    save(spark, paths[0], wide(later), schema)
    told = panel_screen.run(spark, *paths, config)
    assert (told["batch"], told["records"], told["high"]) == ("12", len(later), 40)
    assert hits(spark, paths[2]) == screened(records + later, panel, K)
    assert {r[0] for r in read_if_there(spark, paths[2], panel_screen.HITS).select("batch").distinct().collect()} == {"start", "12"}
    assert spark.read.schema(panel_screen.MARKS).parquet(paths[3]).count() == 2


def test_screen_that_died_is_repeated(spark, growing, monkeypatch):
    folder, panel, records, later = growing
    config = panel_screen.Config(word_length=K, min_matches=2)
    paths = [str(folder / n) for n in ("records", "panel", "out", "state")]
    save(spark, paths[0], records, "doc_id long, text string")
    real = panel_screen.overwrite_parts

    def dies(table, path, *parts):
        if path == paths[3]:
            raise RuntimeError("lost")
        real(table, path, *parts)

    monkeypatch.setattr(panel_screen, "overwrite_parts", dies)
    with pytest.raises(RuntimeError):
        panel_screen.run(spark, *paths, config)
    monkeypatch.setattr(panel_screen, "overwrite_parts", real)
    save(spark, paths[0], later, "doc_id long, text string")
    panel_screen.run(spark, *paths, config)
    assert hits(spark, paths[2]) == {key: v for key, v in screened(records + later, panel, K).items() if v[0] >= 2}


def test_screen_without_records_or_panel(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("records", "panel", "out", "state")]
    save(spark, paths[0], [], "doc_id long, text string")
    save(spark, paths[1], [], "item_id long, text string")
    assert panel_screen.run(spark, *paths)["records"] == 0
    save(spark, paths[0], [(1, "acgt" * 20)], "doc_id long, text string")
    assert panel_screen.run(spark, *paths)["hits"] == 0 and panel_screen.run(spark, *paths)["records"] == 0
    with pytest.raises(ConfigError):
        panel_screen.run(spark, *paths, panel_screen.Config(word_length=32))


TRACK = "chrom string, start long, end long, value double, line_no long, bucket string"


def tiles(rows, tile, threshold):
    last = {}
    for chrom, start, end, value, line in rows:
        if None not in (chrom, start, end, value, line) and start >= 0 and end == start + 1:
            last[chrom, start] = max(last.get((chrom, start), (line, value)), (line, value))
    out = {}
    for (chrom, start), (_, value) in last.items():
        if value >= threshold:
            n, total = out.get((chrom, start // tile), (0, 0.0))
            out[chrom, start // tile] = n + 1, total + value
    return out


def stored(spark, out):
    return {(r["chrom"], r["tile"]): (r["sites"], r["pct_sum"]) for r in track_tiles.tiles_of(spark, out).collect()}


def some_rows(rng, n, first):
    return [(rng.choice("abcdefg"), s := rng.randrange(60), s + 1, float(rng.randrange(101)), first + i) for i in range(n)]


def test_track_takes_only_new_files(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    config = track_tiles.Config(tile=20, threshold=40.0, buckets=3, files_per_batch=2)
    paths = [str(tmp_path / n) for n in ("track", "out", "checkpoint")]
    one = some_rows(rng, 120, 1000) + [("h", 5, 6, 90.0, 1), ("i", 5, 6, 90.0, 9000), (None, 1, 2, 3.0, 4), ("a", -1, 0, 3.0, 4), ("a", 1, 3, 3.0, 4), ("a", 1, 2, None, 4), ("a", 1, 2, 99.0, None)]
    two = some_rows(rng, 90, 0) + some_rows(rng, 40, 5000) + [("h", 5, 6, 1.0, 2), ("i", 5, 6, 1.0, 8999)]  # lines before and after those of the first files
    wide = lambda rows: [(*r, "x") for r in rows]
    spark.createDataFrame(wide(one), TRACK).repartition(5).write.parquet(paths[0])
    told = track_tiles.run(spark, *paths, config)
    assert told["rows"] == len(one) and stored(spark, paths[1]) == tiles(one, 20, 40)
    before = {p: os.stat(os.path.join(d, p)).st_mtime_ns for d, _, names in os.walk(paths[1]) for p in names}
    assert track_tiles.run(spark, *paths, config) == {"rows": 0, "new_positions": 0, "buckets": 0, "sites": 0}
    assert before == {p: os.stat(os.path.join(d, p)).st_mtime_ns for d, _, names in os.walk(paths[1]) for p in names}
    assert stored(spark, paths[1]) == tiles(one, 20, 40)
    save(spark, paths[0], wide(two), TRACK)
    real = track_tiles.settle
    monkeypatch.setattr(track_tiles, "settle", lambda *a: 1 / 0)  # dies when the stream has ended
    with pytest.raises(ZeroDivisionError):
        track_tiles.run(spark, *paths, config)
    monkeypatch.setattr(track_tiles, "settle", real)
    assert track_tiles.run(spark, *paths, config)["rows"] == 0
    assert stored(spark, paths[1]) == tiles(one + two, 20, 40)
    assert ("h", 0) not in stored(spark, paths[1]) and ("i", 0) in stored(spark, paths[1])
    rejected = {r["reason"]: r["n"] for r in spark.read.parquet(f"{paths[1]}/rejects").collect()}
    assert sum(rejected.values()) == 5 and rejected["not one base long"] == 1
    sites = spark.read.parquet(f"{paths[1]}/sites")
    assert sites.count() == sites.select("chrom", "pos").distinct().count()


def test_a_batch_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2, 50.0, 1, "x"), ("a", 2, 3, 0.25, 2, "x")], TRACK)
    config = track_tiles.Config(values="fraction")
    for _ in range(2):
        assert track_tiles.take_batch(rows, 0, str(tmp_path), config) == 2
    assert spark.read.parquet(f"{tmp_path}/deltas").count() == 2
    track_tiles.settle(spark, str(tmp_path), config)
    assert stored(spark, str(tmp_path)) == {("a", 0): (2, 5025.0)}


def test_configurations(tmp_path):
    assert load_config(panel_screen.Config, os.path.join(ROOT, "jobs/panel_screen.json")) == panel_screen.Config()
    assert load_config(track_tiles.Config, os.path.join(ROOT, "jobs/track_tiles.json")).checked().tile == 50
    (tmp_path / "c.json").write_text(json.dumps({"tile": 0}))
    with pytest.raises(ConfigError):
        load_config(track_tiles.Config, tmp_path / "c.json").checked()
    (tmp_path / "c.json").write_text(json.dumps({"tiles": 1}))
    with pytest.raises(ConfigError):
        load_config(track_tiles.Config, tmp_path / "c.json")


def test_job_queries_match_sql(spark, tmp_path):
    rng = random.Random(2)
    item = "".join(rng.choice("acgt") for _ in range(80))
    docs = [(i, "see " + item[: 20 + 3 * i] + " and " + turned(item.upper())[i:50], "s") for i in range(20)] + [(None, item, "s"), (30, None, "s"), (30, "", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, item string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, item[10:] + item), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    events = [(i, i % 7 if i % 11 else None, float(i % 600)) for i in range(500)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark", "events"):
        con.sql(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    kept = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    for name, fn in queries.QUERIES.items():
        df, rel = fn(spark, str(tmp_path)), con.sql(queries.ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert sorted(map(repr, df.select(*rel.columns).collect())) and sorted(repr(tuple(r)) for r in df.select(*rel.columns).collect()) == sorted(map(repr, rel.fetchall())), name
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == kept


def test_command_line(spark, tmp_path):
    save(spark, tmp_path / "track", [("a", 1, 2, 50.0, 1, "x")], TRACK)
    (tmp_path / "c.json").write_text("{}")
    given = [f"--{n}={tmp_path}/{n}" for n in ("track", "out", "checkpoint")]
    done = subprocess.run([sys.executable, "-m", "jobs.track_tiles", *given, f"--config={tmp_path}/c.json", "--master=local[2]"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "read 1 new rows" in done.stderr, done.stderr[-2000:]
    assert stored(spark, str(tmp_path / "out")) == {("a", 0): (1, 50.0)}
