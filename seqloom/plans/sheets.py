"""Many plots at once: a table of plot requests is merged with defaults, checked and measured in columns.

A request is a JSON object as in a configuration file.  ``configured`` tells what each asks for and what is wrong with it,
``measured`` where the parts of its image stand and what its labels say; nothing is drawn or read for either, so a table
of millions of pairs of records can be looked through before the few that are worth an image are rendered.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import regions, text
from seqloom.plans import font
from seqloom.plans.config import SAID, Config
from seqloom.plans.layout import LEGEND, PROPORTIONS, WIDEST_NUMBER, tick_count_column
from seqloom.plans.scale import scale_columns
from seqloom.sources.fasta import EXTENSIONS
from seqloom.sources.track import FLOAT, FORMATS

_TYPES = {"str": "string", "bool": "boolean", "float": "double", "int": "int"}
#: Spark's type of each option.
OPTIONS = {f.name: _TYPES[f.type.split(" ")[0]] for f in fields(Config)}


def _settled(table: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``table`` with columns from a generator, so that no later filter or projection repeats what they are made of."""
    kept = [f"`{c}`" for c in table.columns if c not in columns]
    return table.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def extension(path: Column) -> Column:
    """In lower case, a trailing .gz aside; empty without one."""
    return F.regexp_extract(F.regexp_replace(F.lower(file_name(path)), r"\.gz$", ""), r"\.([^.]*)$", 1)


def _read(said: Column, kind: str) -> Column:
    """A value of a JSON object as an option's type; null if it isn't one."""
    if kind == "string":
        return said
    if kind == "boolean":
        return F.when(said.isin("true", "false"), said == "true")
    return F.when(said.rlike(r"^[+-]?[0-9]+$" if kind == "int" else FLOAT), said.try_cast(kind))


def _first(checks: list[tuple[Column, Column | str]]) -> Column:
    """What the first check that holds says; null if none does."""
    out = F.lit(None).cast("string")
    for holds, said in reversed(checks):
        out = F.when(holds, F.lit(said) if isinstance(said, str) else said).otherwise(out)
    return out


def _checks(given: Column, plot: Column) -> list[tuple[Column, Column | str]]:
    """Checks of a request in the order in which ``Config.checked`` and ``load`` make them."""

    def there(*names: str) -> Column:
        return F.exists(F.array(*[F.coalesce(plot[n], F.lit("")) for n in names]), lambda v: v != "")

    def quoted(said: str, name: Column) -> Column:
        return F.concat(F.lit(f"{said}: '"), name, F.lit("'"))

    unknown = F.array_min(F.array_except(F.map_keys(given), F.array(*[F.lit(n) for n in OPTIONS])))
    one, track = plot["sequence"].isNotNull(), plot["methylation"].isNotNull()
    sequences = [plot[n] for n in ("sequence", "fst_sequence", "snd_sequence")]
    tracks = [plot[n] for n in ("methylation", "fst_methylation", "snd_methylation")]
    return [
        (given.isNull(), SAID["object"]),
        (unknown.isNotNull(), quoted(SAID["key"], unknown)),
        *[(given[n].isNotNull() & _read(given[n], kind).isNull(), f"{SAID['type']}: '{n}'") for n, kind in OPTIONS.items()],
        (one & there("fst_sequence", "snd_sequence"), SAID["sequences"]),
        (~one & ~(there("fst_sequence") & there("snd_sequence")), SAID["sequence"]),
        (track & there("fst_methylation", "snd_methylation"), SAID["tracks"]),
        (there("fst_methylation") != there("snd_methylation"), SAID["both"]),
        ((track & ~one) | (plot["fst_methylation"].isNotNull() & one), SAID["match"]),
        (plot["region"].isNotNull() & there("fst_region", "snd_region"), SAID["regions"]),
        (~plot["methylation_threshold"].between(0, 100), SAID["threshold"]),
        (~plot["plot_side"].between(350, 12_500), SAID["side"]),
        (plot["word_length"] < 1, SAID["word"]),
        (~plot["on_mismatch"].isin("prune", "error"), SAID["mismatch"]),
        *[(plot[n].isNotNull() & regions.parse_region(plot[n]).isNull(), quoted(SAID["region"], plot[n])) for n in ("region", "fst_region", "snd_region")],
        *[(p.isNotNull() & ~extension(p).isin(*EXTENSIONS), quoted(SAID["extension"], p)) for p in sequences],
        *[(p.isNotNull() & ~extension(p).isin(*FORMATS), quoted(SAID["extension"], p)) for p in tracks],
    ]


def configured(requests: DataFrame, json_col: str = "request", base: Config | None = None, plot_col: str = "plot", problem_col: str = "problem") -> DataFrame:
    """``requests`` with a struct of all options and the first problem of each, null for those that can be plotted.

    What a request gives goes before ``base``, and that before the defaults.  Texts that read as an option's type count as
    given; null, empty and other texts that are no JSON object are a problem, and their options are those of ``base``.
    """
    start = (base or Config()).with_defaults()
    read = _settled(requests, {"_sl_given": F.from_json(json_col, "map<string,string>")})
    given = F.col("_sl_given")
    options = [F.coalesce(_read(given[n], kind), F.lit(getattr(start, n)).cast(kind)).alias(n) for n, kind in OPTIONS.items()]
    merged = _settled(read, {plot_col: F.struct(*options)})
    return _settled(merged, {problem_col: _first(_checks(given, F.col(plot_col)))}).drop("_sl_given")


def _labels(axis: dict[str, Column], region: Column) -> Column:
    """The region that an axis shows: [label, label in file names]."""
    whole = F.when(axis["multi"], F.struct(F.lit("slice").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(0).cast("long").alias("start"), axis["length"].cast("long").alias("end")))
    single = F.struct(F.lit("id").alias("kind"), axis["id"].alias("id"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    shown = F.coalesce(regions.parse_region(region), whole, single)
    return F.get(F.transform(F.array(shown), lambda r: F.array(regions.pretty(r), regions.file_label(r))), F.lit(0))


def _title(path: Column, multi: Column) -> Column:
    return F.concat(F.when(multi, F.lit("Multi FASTA (")).otherwise(F.lit("FASTA (")), text.truncate(file_name(path), 40), F.lit(")"))


def _ticks(length: Column, pixels: Column, at_border: bool) -> Column:
    """Array of (value, at): the last of a vertical axis shows the end, a horizontal one has one more for it."""
    parts = tick_count_column(length) - 1
    step, apart = F.call_function("div", length, parts), F.call_function("div", pixels, parts)

    def tick(value: Column, at: Column) -> Column:
        return F.struct(value.cast("long").alias("value"), at.cast("long").alias("at"))

    even = F.transform(F.sequence(F.lit(0), parts if at_border else parts - 1), lambda i: tick(i * step, i * apart))
    return F.concat(even, F.array(tick(length, pixels if at_border else parts * apart)))


def measured(plots: DataFrame, x_col: str = "x", y_col: str = "y", plot_col: str = "plot", problem_col: str = "problem", page_col: str = "page") -> DataFrame:
    """``configured`` plots with a struct of where the parts of the image stand and what its labels say.

    ``x_col`` and ``y_col`` are structs (id, multi, length): the record, whether the file has several, and how many bases the
    axis shows.  Sequences that are shorter than a word are a problem too.  Plots with a problem have no page.
    """
    structs = {plot_col: tuple(OPTIONS), x_col: ("id", "multi", "length"), y_col: ("id", "multi", "length")}
    plot, x, y = ({f: F.col(f"_sl_{c}_{f}") for f in of} for c, of in structs.items())
    flat = plots.withColumns({f"_sl_{c}_{f}": F.col(c)[f] for c, of in structs.items() for f in of})
    side, w, h = plot["plot_side"].cast("long"), x["length"].cast("long"), y["length"].cast("long")
    short = [(a["length"] < plot["word_length"], F.concat(F.lit(f"the {name} sequence has "), a["length"], F.lit(" bases, words have "), plot["word_length"])) for name, a in (("first", x), ("second", y))]
    out = _settled(flat, {problem_col: F.coalesce(problem_col, _first(short))})
    good = F.col(problem_col).isNull()

    tiles = {n: F.when(good, c.cast("long")) for n, c in scale_columns(side, w, h).items()}
    out = _settled(out, {f"_sl_{n}": c for n, c in tiles.items()})
    tw, th = F.col("_sl_out_w"), F.col("_sl_out_h")
    grown = plot["enlarge_small"] & (tw < side) & (th < side)
    out = _settled(out, {
        "_sl_grown": grown,
        "_sl_w": F.when(~grown, tw).when(tw >= th, side).otherwise(F.floor(side / th * tw)),
        "_sl_h": F.when(~grown, th).when(tw >= th, F.floor(side / tw * th)).otherwise(side),
    })
    grown, width, height = (F.col(f"_sl_{n}") for n in ("grown", "w", "h"))

    def share(of: Column, name: str) -> Column:
        return F.floor(of * PROPORTIONS[name] + 0.5)

    margin = F.floor(side * PROPORTIONS["margin"] + 1e-9)
    letters = F.floor(margin * PROPORTIONS["text_of_margin"] + 1e-9)
    pixel = F.greatest(F.lit(1).cast("long"), F.call_function("div", letters, F.lit(font.HEIGHT)))
    room = share(pixel * font.text_width(WIDEST_NUMBER, 1), "tick_label_of_text")
    tracked = plot["methylation"].isNotNull() | plot["fst_methylation"].isNotNull()
    none = F.array().cast("array<string>")
    paths = [F.coalesce(plot["sequence"], plot[n]) for n in ("fst_sequence", "snd_sequence")]
    titles = F.concat(
        F.array(F.concat_ws(" vs. ", *[_title(p, a["multi"]) for p, a in zip(paths, (x, y), strict=True)]), F.lit(""), F.concat(F.lit("Word length: "), plot["word_length"])),
        F.when(tracked, F.array(F.format_string("Methylation threshold: %.1f%%", plot["methylation_threshold"]))).otherwise(none),
        F.when(grown, F.array(F.lit(""), F.concat(F.lit("(plot was enlarged to fit "), text.thousands(side), F.lit("px resolution)")))).otherwise(none),
    )
    alone = plot["sequence"].isNotNull() & (plot["fst_rev"] == plot["snd_rev"])
    regions_of = [F.coalesce(plot["fst_region"], plot["region"])]
    regions_of.append(F.when(alone, regions_of[0]).otherwise(F.coalesce(plot["snd_region"], plot["region"])))
    out = _settled(out, {
        "_sl_margin": margin, "_sl_text": letters, "_sl_pixel": pixel, "_sl_room": room, "_sl_titles": titles,
        "_sl_x": _labels(x, regions_of[0]), "_sl_y": _labels(y, regions_of[1]),
    })
    margin, letters, pixel, room, titles, x_at, y_at = (F.col(f"_sl_{n}") for n in ("margin", "text", "pixel", "room", "titles", "x", "y"))

    left = margin + room
    top = margin + (F.size(titles) + 2) * (letters + F.floor(letters * PROPORTIONS["gap_of_text"]))
    legend_w, legend_h = share(margin, "legend_of_margin"), share(side, "legend_height")
    legend_y = top + F.call_function("div", side - legend_h, F.lit(2))
    threshold = plot["methylation_threshold"] / 100.0

    def named(label: Column, turned: Column, room_for: Column) -> Column:
        shown = text.axis_label(F.get(label, F.lit(0)), turned)
        return F.when(F.length(shown) * font.CELL * pixel <= room_for, shown)

    def ticks(length: Column, pixels: Column, at_border: bool) -> Column:
        fits = tick_count_column(length) * letters < pixels
        return F.when(fits, _ticks(length, pixels, at_border)).otherwise(F.array().cast("array<struct<value:bigint,at:bigint>>"))

    parts = {
        "tile_w": F.col("_sl_tile_w"), "tile_h": F.col("_sl_tile_h"), "width": width, "height": height, "enlarged": grown,
        "plot_x": left + F.call_function("div", side - width, F.lit(2)), "plot_y": top + F.call_function("div", side - height, F.lit(2)),
        "legend_x": left + side + F.call_function("div", left, F.lit(2)), "legend_y": legend_y, "legend_w": legend_w, "legend_h": legend_h,
        "canvas_w": left * 2 + side + legend_w, "canvas_h": top * 2 + side + room,
        "text": letters, "border": share(side, "border"), "titles": titles,
        "x_label": named(x_at, plot["fst_rev"], width), "y_label": named(y_at, plot["snd_rev"], height),
        "x_ticks": ticks(w, width, True), "y_ticks": ticks(h, height, False),
        "legend": F.array(*[F.struct(F.lit(name).alias("name"), (legend_y + (legend_h * (1 - at) - letters / 2).cast("long")).alias("y")) for at, name in LEGEND]),
        "threshold_y": F.when(tracked, legend_y + F.floor(legend_h * (1 - threshold))),
        "file": F.concat(F.get(x_at, F.lit(1)), F.lit("__"), F.get(y_at, F.lit(1)), F.lit(".png")),
    }
    page = F.when(good, F.struct(*[c.alias(n) for n, c in parts.items()]))
    return _settled(out, {page_col: page}).select(*[f"`{c}`" for c in plots.columns if c != page_col], f"`{page_col}`")
