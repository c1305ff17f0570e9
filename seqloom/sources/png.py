"""PNG sink: executors paint and compress bands of rows, the driver joins their bytes.

A band's rows are deflated on their own and end with a flush to a byte's border, so the bands one after the other are one
stream; the checksum of all rows follows from those of the bands and their lengths.  A plot is at most 12,500 pixels wide
and high; the driver holds one compressed band.
"""

from __future__ import annotations

import datetime
import json
import os
import struct
import time
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.color import FRACTIONS, STOPS, _to_linear
from seqloom.operators.raster import scanlines
from seqloom.plans.durable import materialise, scratch
from seqloom.plans.layout import Page
from seqloom.plans.ship import ship_package


#: Bytes of a band before compression.
BAND = 4 << 20
#: Fixed value: the modulus of Adler-32.
ADLER = 65521


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def row_bytes(pixels: DataFrame, width: int) -> DataFrame:
    """(y, line): the RGB bytes of each row that has a pixel; pixels that are absent are white."""

    def paint(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = batch.column(1)
            ends, flat = dots.offsets.to_numpy(), dots.flatten()
            xs = flat.field("x").to_numpy(zero_copy_only=False)
            rgb = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "rgb"], axis=1).astype(np.uint8)
            ends = ends - ends[0]
            lines = []
            for a, b in zip(ends, ends[1:]):
                line = np.full((width, 3), 255, np.uint8)
                line[xs[a:b]] = rgb[a:b]
                lines.append(line.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lines, pa.binary())], names=["y", "line"])

    ship_package(pixels.sparkSession)
    return scanlines(pixels).select(F.col("y").cast("long").alias("y"), "dots").mapInArrow(paint, "y long, line binary")


def legend_colour(fraction: float) -> bytes:
    """The colour scale at a fraction, on the driver."""
    out = []
    for k in range(3):
        value = STOPS[-1][k]
        for i in reversed(range(len(STOPS) - 1)):
            if fraction <= FRACTIONS[i + 1]:
                a, b = _to_linear(STOPS[i][k]), _to_linear(STOPS[i + 1][k])
                c = a + (b - a) * (fraction - FRACTIONS[i]) / (FRACTIONS[i + 1] - FRACTIONS[i])
                s = c * 12.92 if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055
                value = min(255, max(0, int(s * 255 + 0.5)))
        out.append(value)
    return bytes(out)


def canvas_rows(lines: dict[int, bytes], page: Page, boxes: list[tuple[int, int, int, int]], first: int, last: int) -> Iterator[bytes]:
    """Rows ``first`` to ``last`` (exclusive) of the whole canvas: the plot's lines, the legend and black boxes on white; a box
    is looked at in its own rows only."""
    w, _ = page.canvas
    x0, y0, pw, _ = page.plot
    sx, sy, sw, sh = page.legend
    waiting, open_boxes = sorted(boxes, key=lambda b: -b[1]), []
    for y in range(first, last):
        line = bytearray(b"\xff" * (3 * w))
        if y - y0 in lines:
            line[3 * x0 : 3 * (x0 + pw)] = lines[y - y0]
        if sy <= y < sy + sh:
            line[3 * sx : 3 * (sx + sw)] = legend_colour(1.0 - (y - sy) / sh) * sw
        while waiting and waiting[-1][1] <= y:
            open_boxes.append(waiting.pop())
        open_boxes = [b for b in open_boxes if y < b[1] + b[3]]
        for x, _, width, _ in open_boxes:
            line[3 * x : 3 * (x + width)] = b"\x00" * (3 * width)
        yield bytes(line)


def packed_bands(pixels: DataFrame, page: Page, boxes: list[tuple[int, int, int, int]], rows: int | None = None) -> DataFrame:
    """(band, data, check, n): bands of ``rows`` rows of the canvas from top to bottom as parts of one deflate stream, with the
    Adler-32 and number of their bytes before compression."""
    w, h = page.canvas
    size = rows or max(1, BAND // (3 * w))
    n = -(-h // size)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        band = key[0].as_py()
        lines = {y: line for y, line in zip(table.column("y").to_pylist(), table.column("line").to_pylist(), strict=True) if line is not None}
        raw = b"".join(b"\x00" + row for row in canvas_rows(lines, page, boxes, band * size, min(h, (band + 1) * size)))
        deflate = zlib.compressobj(9, wbits=-15)
        data = deflate.compress(raw) + deflate.flush(zlib.Z_FINISH if band == n - 1 else zlib.Z_FULL_FLUSH)
        return pa.Table.from_arrays([pa.array([x], kind) for x, kind in ((band, pa.int32()), (data, pa.binary()), (zlib.adler32(raw), pa.int64()), (len(raw), pa.int64()))], names=["band", "data", "check", "n"])

    own = row_bytes(pixels, page.plot[2]).select(F.floor((F.col("y") + page.plot[1]) / size).cast("int").alias("band"), "y", "line")
    every = pixels.sparkSession.range(n).select(F.col("id").cast("int").alias("band"), F.lit(-1).cast("long").alias("y"), F.lit(None).cast("binary").alias("line"))
    return own.unionByName(every).groupBy("band").applyInArrow(pack, "band int, data binary, check long, n long")


def joined_check(one: int, other: int, n: int) -> int:
    """Adler-32 of bytes with checksum ``one`` and ``n`` more with ``other``."""
    a, b = (one & 0xFFFF) + (other & 0xFFFF) - 1, (one >> 16) + (other >> 16) + n * ((one & 0xFFFF) - 1)
    return b % ADLER << 16 | a % ADLER


def write_png(bands: DataFrame, width: int, height: int, path: str, texts: dict[str, str] | None = None) -> None:
    """An RGB8 image of ``packed_bands``, best compression; a part of the stream for each band."""
    check = 1
    with scratch(bands.sparkSession), open(path, "wb") as out:
        out.write(b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)))
        for key, text in (texts or {}).items():
            out.write(_chunk(b"iTXt", key.encode("latin-1") + b"\x00\x00\x00\x00\x00" + text.encode()))
        out.write(_chunk(b"IDAT", b"\x78\xda"))  # the stream's head
        for band in materialise(bands, "png-bands").orderBy("band").toLocalIterator():
            check = joined_check(check, band["check"], band["n"])
            out.write(_chunk(b"IDAT", bytes(band["data"])))
        out.write(_chunk(b"IDAT", struct.pack(">I", check)) + _chunk(b"IEND", b""))


def unique_path(folder: str, name: str, ext: str = "png") -> str:
    """A path that doesn't exist yet; folders are made, taken names get the time, three times at most."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.{ext}")
    for _ in range(3):
        if not os.path.exists(path):
            return path
        path = os.path.join(folder, f"{name}__{datetime.datetime.now():%Y-%m-%d_%H-%M-%S}.{ext}")
        if not os.path.exists(path):
            return path
        time.sleep(0.1)
    raise FileExistsError(path)


def write_sidecar(path: str, annotations: dict) -> None:
    """Labels, ticks and measures as JSON beside the image, for programs."""
    with open(path.rsplit(".", 1)[0] + ".json", "w", encoding="utf-8") as out:
        json.dump(annotations, out, indent=1)
