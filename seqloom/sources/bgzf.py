"""Block-gzip files (BGZF) read by many tasks.

Such a file is a chain of gzip members of at most 64 KB, each of which tells its own size, so a task can start at any of them.
A range of compressed bytes takes the blocks that begin in it, and of their text the lines that begin behind the first
line feed (the first range also the first line), up to the first line feed behind its blocks.  Plain gzip has no such
members: Spark reads it in one task.
"""

from __future__ import annotations

import logging
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.errors import MalformedInput
from seqloom.plans.ship import ship_package
from seqloom.sources.byte_ranges import opened, spread, stamps

log = logging.getLogger(__name__)

#: How a block begins, and the most bytes that it has.
MAGIC, MOST = b"\x1f\x8b\x08\x04", 1 << 16
#: Compressed bytes of a range.
SPLIT = 16 << 20


def block_size(head: bytes) -> int | None:
    """Bytes of the block that begins with ``head``, None if none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    (extra,) = struct.unpack_from("<H", head, 10)
    at = 12
    while at + 4 <= min(12 + extra, len(head)):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def is_bgzf(file: str) -> bool:
    """Whether a file, given by URI, is one that this module reads."""
    try:
        with opened(file) as handle:
            return block_size(handle.read_at(256, 0)) is not None
    except (OSError, ValueError, NotImplementedError):
        return False


def unpacked(raw: bytes) -> bytes:
    """The text of a block."""
    (extra,) = struct.unpack_from("<H", raw, 10)
    text = zlib.decompress(raw[12 + extra : -8], wbits=-15)
    if struct.unpack("<II", raw[-8:]) != (zlib.crc32(text), len(text)):
        raise MalformedInput("a block of a compressed file is damaged")
    return text


def first_block(handle: pa.NativeFile, at: int, end: int) -> int:
    """Where the first block at or behind ``at`` begins; ``end`` if there is none."""
    window, base = handle.read_at(3 * MOST, at), at
    found = window.find(MAGIC)
    while found >= 0:
        size = block_size(window[found : found + 256])
        if size is not None:
            after = base + found + size
            if after == end or block_size(handle.read_at(256, after)) is not None:
                return base + found
        found = window.find(MAGIC, found + 1)
    return end


def _texts(handle: pa.NativeFile, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(where it begins, text) of each block from ``at`` on."""
    while at < end:
        size = block_size(handle.read_at(256, at))
        if size is None:
            raise MalformedInput("a block of a compressed file is damaged")
        yield at, unpacked(handle.read_at(size, at))
        at += size


def lines_of_range(handle: pa.NativeFile, start: int, stop: int, end: int) -> Iterator[list[bytes]]:
    """The lines of one range, block by block."""
    at = first_block(handle, start, end) if start else 0
    held, skipping = b"", start > 0
    for where, text in _texts(handle, at, end):
        if skipping and where >= stop:
            return
        if skipping:
            _, feed, text = text.partition(b"\n")
            if not feed:
                continue
            skipping = False
        if where >= stop:
            rest, feed, _ = text.partition(b"\n")
            held += rest
            if feed:
                yield [held]
                return
            continue
        *whole, held = (held + text).split(b"\n")
        if whole:
            yield whole
    if held and not skipping:
        yield [held]


def raw_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(split, line_no, value) as ``byte_ranges.raw_lines`` has them, of one block-gzip file."""
    every = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / split))
    ranges = stamps(spark, path).select("file", F.col("length").alias("end"), F.explode(every).alias("k"))
    ranges = spread(ranges.select("file", (F.col("k") * split).alias("start"), F.least((F.col("k") + 1) * split, F.col("end")).alias("stop"), "end"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["file"]) as handle:
                    n = 0
                    for lines in lines_of_range(handle, r["start"], r["stop"], r["end"]):
                        numbers = pa.array(range(n, n + len(lines)), pa.int64())
                        n += len(lines)
                        columns = [pa.array([r["file"]] * len(lines)), pa.array([r["start"]] * len(lines), pa.int64()), numbers, pa.array([x.decode() for x in lines])]
                        yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "line_no", "value"])

    ship_package(spark)
    lines = ranges.mapInArrow(run, "file string, start long, line_no long, value string")
    return lines.select(F.struct("file", "start").alias("split"), "line_no", "value")
