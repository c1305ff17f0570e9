"""The engine's front: from two sequences and optional tracks to tables of matches, cells and pixels, or an image.

Everything stays a DataFrame until an image is asked for; only lengths, value ranges and violations are read early.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.errors import InvalidInput
from seqloom.functions.bases import kmer_text
from seqloom.operators import matching, methylation, raster, runs
from seqloom.operators.sequence import reverse_complement_pieces, words
from seqloom.plans import layout
from seqloom.plans.config import Config
from seqloom.plans.scale import TileScale
from seqloom.sources import png
from seqloom.sources.fasta import EXTENSIONS, Sequence, check_extension, read_sequence
from seqloom.sources.track import read_track


@dataclass(frozen=True)
class Dotplot:
    """A comparison of x with y; sites are None where no methylation is given."""

    x: Sequence
    y: Sequence
    word_length: int
    max_side: int
    dot_size: int = 1
    x_sites: DataFrame | None = None
    y_sites: DataFrame | None = None
    same: bool = False
    #: Which axes are reverse complements.
    turned: tuple[bool, bool] = (False, False)
    #: Sites that were pruned for not being on a cytosine, by axis; None without a track or pruning.
    removed: tuple[int | None, int | None] = (None, None)

    def __post_init__(self) -> None:
        for name, axis in (("first", self.x), ("second", self.y)):
            if axis.length < self.word_length:
                raise InvalidInput(f"the {name} sequence has {axis.length} bases, words have {self.word_length}")

    @property
    def scale(self) -> TileScale:
        return TileScale.fit(self.max_side, self.x.length, self.y.length)

    def _kmers(self) -> tuple[DataFrame, DataFrame]:
        upper = self.x.upper and self.y.upper
        xs = words(self.x.pieces, self.word_length, upper)
        return xs, xs if self.same else words(self.y.pieces, self.word_length, upper)

    def axes(self) -> tuple[layout.AxisInfo, layout.AxisInfo]:
        """What the axes show; ticks count the bases of what is shown from 0, on whichever strand."""
        every = zip((self.x, self.y), self.turned, strict=True)
        x, y = (layout.AxisInfo(layout.axis_label(a.label.pretty(), turned), 0, a.length) for a, turned in every)
        return x, y

    def matches(self, max_copies: int | None = None) -> DataFrame:
        """(x, y, kmer) of all matches, or of those words only that have at most ``max_copies`` copies on an axis."""
        xs, ys = self._kmers()
        pairs = matching.match_pairs(xs, ys, max_copies)
        packed = dict(xs.dtypes)["kmer"] == "bigint"
        return pairs.withColumn("kmer", kmer_text(F.col("kmer"), self.word_length)) if packed else pairs

    def maximal_matches(self, max_copies: int | None = None) -> DataFrame:
        """(x, y, length) of the maximal exact matches of at least the words' length; ``max_copies`` as in ``matches``."""
        return runs.maximal_matches(matching.match_pairs(*self._kmers(), max_copies), self.word_length)

    def hits(self) -> DataFrame:
        """(tx, ty, hits)."""
        return matching.tile_hits(*self._kmers(), self.scale)

    def cells(self) -> DataFrame | None:
        """(tx, ty, pct) of methylated tiles."""
        return methylation.meth_cells(self.x_sites, self.y_sites, self.scale) if self.x_sites is not None else None

    def pixels(self) -> DataFrame:
        """(x, y, r, g, b): coloured cells, grown, under black dots, grown."""
        black = raster.dilate_black(self.hits().selectExpr("tx AS x", "ty AS y"), self.dot_size)
        if self.x_sites is None:
            black = black.selectExpr("x", "y", "0 AS r", "0 AS g", "0 AS b")
            return black
        return raster.composite(raster.dilate_colour(methylation.coloured(self.cells()), self.dot_size), black)


def _sites(spark: SparkSession, path: str, axis: Sequence, config: Config) -> tuple[DataFrame | None, int | None]:
    """Sites of a track, and how many were pruned."""
    region = axis.label if axis.cut else None
    rows = read_track(spark, path, region.id if region is not None and region.kind == "id" else None)
    sites = methylation.read_sites(rows, axis.contigs, region, config.methylation_threshold)
    if sites is None:
        return None, None
    if config.on_mismatch == "prune":
        return methylation.pruned(sites, axis.pieces)
    return methylation.settle_mismatches(sites, axis.pieces, config.on_mismatch), None


def _turned(axis: Sequence, sites: DataFrame | None) -> tuple[Sequence, DataFrame | None]:
    """An axis and its sites on the other strand."""
    turned = replace(axis, pieces=reverse_complement_pieces(axis.pieces, axis.length))
    return turned, None if sites is None else methylation.mirrored(sites, axis.length)


def load(spark: SparkSession, config: Config) -> Dotplot:
    """Read what a configuration names.

    One sequence is compared with itself in the first axis' region, unless the strands differ: then both axes are read
    on their own.  Two tracks are used together or not at all.
    """
    c = config.checked()
    paths = (c.sequence, c.sequence) if c.sequence else (c.fst_sequence, c.snd_sequence)
    tracks = (c.methylation, c.methylation) if c.methylation else (c.fst_methylation, c.snd_methylation)
    turns = (c.fst_rev, c.snd_rev)
    alone = c.sequence is not None and turns[0] == turns[1]
    regions = c.regions()
    axes, sites, removed = [], [], []
    for path, track, region in list(zip(paths, tracks, regions, strict=True))[: 1 if alone else 2]:
        check_extension(path, EXTENSIONS)
        axis = read_sequence(spark, path, region)
        if axis is None:
            raise InvalidInput(f"no data in {path} for region {region.pretty() if region else 'all'}")
        axes.append(axis)
        found, gone = _sites(spark, track, axis, c) if track else (None, None)
        sites.append(found)
        removed.append(gone)
    if any(s is None for s in sites):
        sites = [None] * len(sites)
    turned = [_turned(a, s) if turn else (a, s) for a, s, turn in zip(axes, sites, turns, strict=False)]
    (x, x_sites), (y, y_sites) = turned[0], turned[-1]
    return Dotplot(x, y, c.word_length, c.plot_side, c.dot_size, x_sites, y_sites, alone, turns, (removed[0], removed[-1]))


def annotations(plot: Dotplot, page: layout.Page, titles: list[str]) -> dict:
    """Labels, ticks and measures of an image."""
    (x, y), (_, _, width, height) = plot.axes(), page.plot
    return {
        "titles": titles,
        "x_label": x.label if page.width_of(x.label) <= width else None,
        "y_label": y.label if page.width_of(y.label) <= height else None,
        "x_ticks": [[f"{v:,}", at] for v, at in layout.horizontal_ticks(x.length, width, x.start)],
        "y_ticks": [[f"{v:,}", at] for v, at in layout.vertical_ticks(y.length, height, y.start)],
        "legend": [list(stop) for stop in layout.LEGEND],
        "removed_sites": list(plot.removed),
        "origin": list(page.plot[:2]),
        "canvas": list(page.canvas),
        "sidebar": list(page.legend),
    }


def render(spark: SparkSession, config: Config) -> str:
    """Write the image of a configuration and its labels; returns the image's path."""
    c = config.checked()
    plot = load(spark, c)
    scale, pixels = plot.scale, plot.pixels()
    width, height, side = scale.out_w, scale.out_h, c.plot_side
    enlarged = c.enlarge_small and width < side and height < side
    if enlarged:
        pixels, width, height = raster.enlarge(pixels, width, height, side)
    paths = (c.sequence, c.sequence) if c.sequence else (c.fst_sequence, c.snd_sequence)
    names = [layout.axis_title(os.path.basename(p), a.multi) for p, a in zip(paths, (plot.x, plot.y), strict=True)]
    threshold = c.methylation_threshold if plot.x_sites is not None else None
    titles = layout.title_lines(*names, c.word_length, threshold, side if enlarged else None)
    page = layout.arrange(side, width, height, len(titles))
    bands = png.packed_bands(pixels, page, layout.black_boxes(page, titles, *plot.axes(), threshold))
    path = png.unique_path(c.output_dir, f"{plot.x.label.file_label()}__{plot.y.label.file_label()}")
    png.write_png(bands, *page.canvas, path, {"Title": titles[0], "Comment": "\n".join(titles[1:])})
    png.write_sidecar(path, annotations(plot, page, titles))
    for gone in dict.fromkeys(n for n in plot.removed if n):
        print(f"pruned {gone:,} sites that are not on a cytosine", file=sys.stderr)
    return path
