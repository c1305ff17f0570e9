"""Tracks as Spark data sources: ``spark.read.format("bedmethyl").load(path)`` and ``"bedgraph"``.

    register(spark)
    spark.read.format("bedmethyl").load("x.bed").where("chrom = 'chr1' AND start >= 1000 AND start < 9000")

A partition is a byte range of a file; it takes the lines that begin in its range.  Comparisons of ``chrom`` and ``start``
with constants are pushed into the scan: rows of other chromosomes are dropped before their numbers are looked at, as
``read_track`` does, and rows outside the bounds never leave the worker.  The first malformed line of a range ends the
query.  Lines are parsed by columns with Arrow, and rows are Arrow batches.  Sources in Python get no columns to
prune, so all four are made.  Files are those that pyarrow opens by path or URI.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from seqloom.errors import InvalidInput, MalformedInput
from seqloom.plans.ship import ship_package
from seqloom.sources.track import COLUMNS, FLOAT, UNSIGNED

SCHEMA = "chrom string, start long, end long, value float"
#: Bytes of a partition, and bytes that are parsed together.
SPLIT, TOGETHER = 64 << 20, 1 << 20
_MOST = (1 << 63) - 1


@dataclass
class Range(InputPartition):
    """Bytes start to stop of a file."""

    file: str
    start: int
    stop: int


def _system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if urlparse(path).scheme else (pa.fs.LocalFileSystem(), path)


def _lines(part: Range) -> Iterator[bytes]:
    """Pieces of about TOGETHER bytes of whole lines that begin in a range."""
    system, where = _system(part.file)
    with system.open_input_file(where) as file:
        at = part.start
        if at:  # the line that the byte before belongs to is another range's
            at -= 1
            while True:
                raw = file.read_at(1 << 16, at)
                end = raw.find(b"\n")
                if end >= 0 or not raw:
                    break
                at += len(raw)
            at += end + 1
        held = b""
        while at < part.stop:
            raw = file.read_at(max(1, min(TOGETHER, part.stop - at)), at)
            if not raw:
                break
            at += len(raw)
            body, feed, rest = (held + raw).rpartition(b"\n")
            held = rest if feed else held + raw
            if feed:
                yield body
        while held:  # the last line may end in another range
            raw = file.read_at(1 << 16, at)
            end = raw.find(b"\n")
            held += raw if end < 0 else raw[:end]
            at += len(raw)
            if end >= 0 or not raw:
                yield held
                break


def _floats(text: pa.Array) -> pa.Array:
    try:
        return text.cast(pa.float32())
    except pa.ArrowInvalid:  # numbers beyond the type are infinite
        with np.errstate(over="ignore"):
            return pa.array(np.array(text.to_pylist(), np.float64).astype(np.float32))


def parse(piece: bytes, names: tuple[str, ...], chroms: set[str] | None, low: int, high: int) -> pa.RecordBatch:
    """The rows of some lines that have one of ``chroms`` and begin in low to high (inclusive)."""
    lines = pc.ascii_trim_whitespace(pa.array(piece.split(b"\n")).cast(pa.string()))
    fields = pc.ascii_split_whitespace(lines)
    blank = pc.equal(lines, "")
    n, width = len(fields), len(names)
    starts, flat = fields.offsets.to_numpy(), fields.flatten()
    sizes = np.where(blank.to_numpy(zero_copy_only=False), 0, np.diff(starts))

    def column(i: int, rows: np.ndarray) -> pa.Array:
        return flat.take(pa.array(starts[:-1][rows] + i))

    own = np.arange(n)
    if chroms is not None:  # a blank line is malformed whatever is asked for
        named = np.zeros(n, bool)
        with_name = np.flatnonzero(sizes > 0)
        named[with_name] = pc.is_in(column(0, with_name), pa.array(sorted(chroms), pa.string())).to_numpy(zero_copy_only=False)
        own = np.flatnonzero(named | (sizes == 0))
    problem, said = np.full(len(own), width, np.int64), {i: f"missing {name} column" for i, name in enumerate(names)}
    short = sizes[own] < width
    problem[short] = sizes[own][short]
    kinds = {1: UNSIGNED, 2: UNSIGNED, width - 1: FLOAT}
    for i, pattern in kinds.items():
        there = np.flatnonzero((sizes[own] > i) & (problem > i))
        text = column(i, own[there])
        good = pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False)
        if pattern == UNSIGNED:  # no more than a BIGINT holds
            digits = pc.utf8_ltrim(pc.utf8_ltrim(text, "+"), "0")
            long = pc.utf8_length(digits)
            over = pc.or_(pc.greater(long, 19), pc.and_(pc.equal(long, 19), pc.greater(digits, str(_MOST))))
            good &= ~over.to_numpy(zero_copy_only=False)
        problem[there[~good]] = i
    if (problem < width).any():
        first = int(np.flatnonzero(problem < width)[0])
        i = int(problem[first])
        raise MalformedInput(said[i] if sizes[own[first]] <= i else f"invalid {names[i]} value")
    start, end = (pc.utf8_ltrim(column(i, own), "+").cast(pa.int64()) for i in (1, 2))
    value = _floats(pc.utf8_lower(pc.utf8_ltrim(column(width - 1, own), "+")))
    kept = pc.and_(pc.greater_equal(start, low), pc.less_equal(start, high))
    return pa.RecordBatch.from_arrays([column(0, own), start, end, value], names=["chrom", "start", "end", "value"]).filter(kept)


class TrackReader(DataSourceReader):
    def __init__(self, path: str, fmt: str, split: int) -> None:
        self.path, self.names, self.split = path, COLUMNS[fmt], split
        self.chroms: set[str] | None = None
        self.low, self.high = -_MOST, _MOST

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("chrom",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = wanted if self.chroms is None else self.chroms & wanted
            elif column == ("start",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, where = _system(self.path)
        found = system.get_file_info(where)
        if found.type == pa.fs.FileType.NotFound:
            raise InvalidInput(f"no file {self.path!r}")
        files = [found] if found.is_file else system.get_file_info(pa.fs.FileSelector(where, recursive=True))
        files = sorted((f for f in files if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        prefix = self.path[: self.path.index("://") + 3] if "://" in self.path else "file://" if self.path.startswith("file:") else ""
        return [Range(prefix + f.path, at, min(at + self.split, f.size)) for f in files for at in range(0, f.size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for piece in _lines(partition):
            yield parse(piece, self.names, self.chroms, self.low, self.high)


class _Track(DataSource):
    fmt = ""

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TrackReader:
        if not self.options.get("path"):
            raise InvalidInput("a track is loaded from a path")
        return TrackReader(self.options["path"], self.fmt, int(self.options.get("split_bytes", SPLIT)))


class BedMethyl(_Track):
    fmt = "bed"

    @classmethod
    def name(cls) -> str:
        return "bedmethyl"


class BedGraph(_Track):
    fmt = "bedgraph"

    @classmethod
    def name(cls) -> str:
        return "bedgraph"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let it push filters into sources written in Python."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BedMethyl)
    spark.dataSource.register(BedGraph)
