"""Arrow batches of bounded size for the operators that run Python on whole texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from seqloom.plans.ship import ship_package

#: Rows of a batch are handed on in slices of about this many bytes of text (at least one row).
SLICE_BYTES = 4 << 20
#: Freed memory goes back to the system after so many bytes of text, and at the end of a task.
TRIM_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, text_at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece come to about ``limit`` bytes."""
    if batch.num_rows == 0:
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def trim() -> None:
    """Hand freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_texts(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, setup: Callable[[], Callable] | None = None, limit: int = SLICE_BYTES, after: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``fn`` to slices of ``df[columns]``; the last of the columns is the text.

    ``setup``, if given, is called once a task and returns the function to apply in place of ``fn``; ``after`` is called
    at its end.  Freed memory goes back to the system again and again, as idle workers stay beside others.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply, since = setup() if setup else fn, 0
        try:
            for batch in batches:
                for piece in slices(batch, len(columns) - 1, limit):
                    out = apply(piece)
                    if out is not None:
                        yield out
                    since += piece.nbytes
                    del out, piece
                    if since >= TRIM_BYTES:
                        trim()
                        since = 0
        finally:
            if after:
                after()
            trim()

    ship_package(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)

