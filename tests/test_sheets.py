"""Tables of plot requests against the plans of single plots."""

import json
import random
from dataclasses import asdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seqloom.errors import SeqloomError
from seqloom.operators import raster
from seqloom.plans import layout, sheets
from seqloom.plans.config import Config, load_json
from seqloom.plans.region import Region
from seqloom.plans.scale import TileScale
from seqloom.plans.ship import ship_file
from seqloom.sources.fasta import EXTENSIONS, check_extension
from seqloom.sources.track import FORMATS

SEQUENCES = ["a.fa", "dir/b.FNA", "c.fasta.gz", "some-name-that-is-much-longer-than-forty-letters.fasta", "d.txt", "e", ""]
TRACKS = ["t.bed", "t.bedgraph", "t.wig", ""]
REGIONS = ["c", "c:1-20", "5-9", ":1-2", "9-5", ""]
AXIS = "struct<id:string,multi:boolean,length:bigint>"


def drawn(seed):
    """A request, mostly one that can be plotted."""
    rng = random.Random(seed)

    def maybe(share, *values):
        return rng.choice(values) if rng.random() < share else None

    pair, odd = rng.random() < 0.5, 0.15
    made = {
        "sequence": maybe(odd if pair else 1, *SEQUENCES[: 4 if rng.random() < 0.8 else 7]),
        "fst_sequence": maybe(1 - odd if pair else odd / 3, *SEQUENCES[:4]), "snd_sequence": maybe(1 - odd if pair else odd / 3, *SEQUENCES[:4]),
        "methylation": maybe(odd if pair else 0.5, *TRACKS[: 2 if rng.random() < 0.8 else 4]),
        "fst_methylation": maybe(odd, *TRACKS[:2]), "snd_methylation": maybe(odd, *TRACKS[:2]),
        "region": maybe(0.3, *REGIONS[: 3 if rng.random() < 0.8 else 6]), "fst_region": maybe(odd, *REGIONS[:3]), "snd_region": maybe(odd, *REGIONS[:3]),
        "fst_rev": maybe(0.5, True, False), "snd_rev": maybe(0.5, True, False), "on_mismatch": maybe(0.5, "prune", "error", "error", "keep"),
        "methylation_threshold": maybe(0.5, 0, 12.5, 100, 30.0, 100.5, -1), "word_length": maybe(0.7, 0, 1, 5, 9, 12), "plot_side": maybe(0.8, 349, 350, 401, 999, 4000, 12_500, 12_501),
        "enlarge_small": maybe(0.6, True, False), "output_dir": maybe(0.1, "out"), "dot_size": maybe(0.2, 0, 3), "parallel": maybe(0.2, True),
    }
    return {k: v for k, v in made.items() if v is not None or rng.random() < 0.05}


def told(request):
    """What is said of a request by the checks of a single plot."""
    try:
        c = Config(**request).checked()
        for path in (c.sequence, c.fst_sequence, c.snd_sequence):
            if path is not None:
                check_extension(path, EXTENSIONS)
        for path in (c.methylation, c.fst_methylation, c.snd_methylation):
            if path is not None:
                check_extension(path, tuple(FORMATS))
    except SeqloomError as e:
        return str(e).split(" of '")[0]
    return None


def test_requests_are_checked_as_single_plots_are(spark):
    requests = [drawn(seed) for seed in range(600)]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(requests)], "i long, request string")
    got = {r["i"]: r for r in sheets.configured(rows).collect()}
    problems = set()
    for i, request in enumerate(requests):
        want = told(request)
        said = got[i]["problem"]
        problems.add(want)
        assert want == (said.split(": '")[0] if said and said.startswith("unknown file") else said), request
        assert got[i]["plot"].asDict() == asdict(Config(**request).with_defaults()), request
    assert len(problems) > 10 and sum(told(r) is None for r in requests) > 100


def test_what_is_no_request(spark, tmp_path):
    bad = {"[1]": "not a JSON object", "5": "not a JSON object", "{": "not a JSON object", '{"colour": 1, "size": 2}': "unknown key: 'colour'", '{"sequence": "a.fa", "word_length": "x"}': "not of the option's type: 'word_length'", '{"sequence": "a.fa", "plot_side": 400.5}': "not of the option's type: 'plot_side'", '{"fst_rev": 1, "sequence": "a.fa"}': "not of the option's type: 'fst_rev'"}
    rows = spark.createDataFrame([(t,) for t in [*bad, None, "", "{}", '{"sequence": "a.fa"}', '{"sequence": "a.fa"}']], "request string")
    got = [(r["request"], r["problem"]) for r in sheets.configured(rows).collect()]
    assert got == [*bad.items(), (None, "not a JSON object"), ("", "not a JSON object"), ("{}", "a sequence is missing"), *[('{"sequence": "a.fa"}', None)] * 2]
    for body, said in bad.items():
        (tmp_path / "c.json").write_text(body)
        with pytest.raises(SeqloomError, match=None if body == "{" else said):
            load_json(str(tmp_path / "c.json"))
    based = sheets.configured(rows.where("request = '{}'"), base=Config(sequence="b.fa", word_length=3)).first()
    assert based["problem"] is None and (based["plot"]["sequence"], based["plot"]["word_length"], based["plot"]["plot_side"]) == ("b.fa", 3, 4000)
    assert sheets.configured(rows.where("false")).count() == 0


def page_of(c, x, y):
    """The page as ``render`` plans it."""
    scale = TileScale.fit(c.plot_side, x["length"], y["length"])
    width, height = scale.out_w, scale.out_h
    grown = c.enlarge_small and width < c.plot_side and height < c.plot_side
    if grown:
        width, height = (int(c.plot_side / height * width), c.plot_side) if width < height else (c.plot_side, int(c.plot_side / width * height))
    paths = (c.sequence, c.sequence) if c.sequence else (c.fst_sequence, c.snd_sequence)
    tracked = c.methylation is not None or c.fst_methylation is not None
    titles = layout.title_lines(*[layout.axis_title(p.rsplit("/", 1)[-1], a["multi"]) for p, a in zip(paths, (x, y))], c.word_length, c.methylation_threshold if tracked else None, c.plot_side if grown else None)
    page = layout.arrange(c.plot_side, width, height, len(titles))
    asked = list(c.regions())
    if c.sequence and c.fst_rev == c.snd_rev:
        asked[1] = asked[0]
    labels = [r or (Region(None, 0, a["length"]) if a["multi"] else Region(a["id"])) for r, a in zip(asked, (x, y))]
    shown = [layout.axis_label(r.pretty(), turned) for r, turned in zip(labels, (c.fst_rev, c.snd_rev))]
    fits = [layout.tick_count(a["length"]) * page.text < n for a, n in ((x, width), (y, height))]
    at = page.legend[1]
    return {
        "tile_w": scale.tile_w, "tile_h": scale.tile_h, "width": width, "height": height, "enlarged": grown, "plot_x": page.plot[0], "plot_y": page.plot[1],
        "legend_x": page.legend[0], "legend_y": at, "legend_w": page.legend[2], "legend_h": page.legend[3], "canvas_w": page.canvas[0], "canvas_h": page.canvas[1],
        "text": page.text, "border": page.border, "titles": titles,
        "x_label": shown[0] if page.width_of(shown[0]) <= width else None, "y_label": shown[1] if page.width_of(shown[1]) <= height else None,
        "x_ticks": layout.horizontal_ticks(x["length"], width) if fits[0] else [], "y_ticks": layout.vertical_ticks(y["length"], height) if fits[1] else [],
        "legend": [(name, at + int(page.legend[3] * (1 - f) - page.text / 2)) for f, name in layout.LEGEND],
        "threshold_y": at + int(page.legend[3] * (1 - c.methylation_threshold / 100.0)) if tracked else None,
        "file": "__".join(r.file_label() for r in labels) + ".png",
    }


def test_pages_are_those_of_single_plots(spark):
    rng = random.Random(5)
    lengths = [1, 2, 5, 9, 20, 99, 100, 350, 399, 401, 5_000, 12_345, 3_000_000_000]
    given = []
    for i, request in enumerate(r for r in map(drawn, range(1500)) if told(r) is None):
        x, y = ({"id": rng.choice(["c", "a-rather-long-identifier-of-a-record-that-fits-no-small-plot"]), "multi": rng.random() < 0.4, "length": rng.choice(lengths)} for _ in "xy")
        given.append((i, json.dumps(request), Row(**x), Row(**y)))
    rows = sheets.configured(spark.createDataFrame(given, f"i long, request string, x {AXIS}, y {AXIS}"))
    got, pages = {r["i"]: r for r in sheets.measured(rows).collect()}, 0
    for i, request, x, y in given:
        c, row = Config(**json.loads(request)).checked(), got[i]
        short = [f"the {name} sequence has {a['length']} bases, words have {c.word_length}" for name, a in (("first", x), ("second", y)) if a["length"] < c.word_length]
        assert row["problem"] == (short[0] if short else None)
        if short:
            assert row["page"] is None
            continue
        pages += 1
        seen = row["page"].asDict()
        for name in ("x_ticks", "y_ticks", "legend"):
            seen[name] = [tuple(t) for t in seen[name]]
        assert seen == page_of(c, x, y), request
    assert pages > 100 and set(rows.columns) == {"i", "request", "x", "y", "plot", "problem"}


def test_grown_sizes_are_those_of_enlarge(spark):
    dots = spark.createDataFrame([(0, 0, 1, 1, 1)], "x int, y int, r int, g int, b int")
    sizes = [(37, 23), (23, 37), (101, 5), (7, 7), (350, 350)]
    rows = spark.createDataFrame([('{"sequence": "a.fa", "word_length": 1, "plot_side": 350, "enlarge_small": true}', Row(id="c", multi=False, length=w), Row(id="c", multi=False, length=h)) for w, h in sizes], f"request string, x {AXIS}, y {AXIS}")
    pages = [r["page"] for r in sheets.measured(sheets.configured(rows)).collect()]
    assert [(p["width"], p["height"]) for p in pages] == [raster.enlarge(dots, w, h, 350)[1:] for w, h in sizes]


def test_other_columns_are_kept(spark):
    rows = spark.createDataFrame([(1, '{"sequence": "a.fa", "word_length": 3}', 7, Row(id="c", multi=False, length=9), "z")], f"`a.b` int, request string, page int, x {AXIS}, given string")
    seen = sheets.measured(sheets.configured(rows).withColumn("y", F.col("x")))
    row = seen.first()
    assert seen.columns == ["a.b", "request", "x", "given", "plot", "problem", "y", "page"]
    assert (row["a.b"], row["given"], row["problem"], row["page"]["file"], row["page"]["width"]) == (1, "z", None, "c__c.png", 9)


def test_files_of_one_name_are_told(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "shipped-once.txt").write_text(folder)
    one, other = (str(tmp_path / folder / "shipped-once.txt") for folder in ("a", "b"))
    assert ship_file(spark, one) == ship_file(spark, one) == "shipped-once.txt"
    with pytest.raises(SeqloomError):
        ship_file(spark, other)


def test_extensions(spark):
    names = ["x.fa", "d.e/x", "d.e/x.FNA.gz", "x.tar.bed", ".fa", "x.", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(sheets.extension(F.col("n")).alias("e"))
    assert [r["e"] for r in rows.collect()] == ["fa", "", "fna", "bed", "fa", "", None]
