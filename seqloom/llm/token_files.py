"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of many documents one after the other, cut into blocks of BLOCK ids.  A block stores its minimum
and the differences to it, packed at the width that holds ``percentile`` of them; the others (outliers) follow as an
exception list of positions and values.  An index of block starts and the lengths of the documents close the file, so
any range of ids can be read by seeking to its blocks.

Layout, little-endian: ``STF1``; blocks, each (minimum u32, ids u16, exceptions u16, width u8), packed differences with
the low bits first, exception positions u16, exception values u32; block starts u64 each; lengths of documents u64
each; document ids i64 each; one byte each that is 1 where the id is null; then blocks, documents, ids in all and the
position of the index, u64 each; ``STF1``.

Documents are dealt over files by ranges of (id, hash of text), so the files in order of their numbers hold the documents in
ascending order of ids (null first), ties are split over files, and no file depends on another.  A task names
its file by number and attempt; the manifest lists those of the attempts that succeeded, and is itself a written table,
so lost executors and repeated tasks leave neither gaps nor doubles.  Files are opened through pyarrow's file systems,
from the shared folder or any URI that they know.

Defined results for odd input: null and empty texts hold the end id alone; equal and null ids stay separate
documents; an empty table gives no file and an empty result; other columns are not read; ids of documents must be
integers.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe
from seqloom.llm.batches import slices, trim
from seqloom.llm.words import WordTable
from seqloom.plans.durable import materialise, new_path
from seqloom.plans.ship import ship_file, ship_package, shipped

MAGIC = b"STF1"
BLOCK = 1024
PERCENTILE = 0.99
#: Bytes of text that are encoded together.
SLICE = 3 << 20
#: Words that the library encodes together.
TOGETHER = 20_000
#: Blocks that are packed or unpacked together.
RUN = 256
_HEAD = struct.Struct("<IHHB")
_TAIL = struct.Struct("<QQQQ4s")


def _widths(top: np.ndarray) -> np.ndarray:
    """Bits of each number, 0 for 0."""
    return np.frexp(top.astype(np.float64))[1].astype(np.int64)


def _lane(width: int) -> np.dtype:
    return np.dtype("<u2") if width <= 16 else np.dtype("<u4")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(g, BLOCK) numbers below 2**width to (g, bytes)."""
    lane = _lane(width)
    bits = np.unpackbits(values.astype(lane)[:, :, None].view(np.uint8), axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    lane = _lane(width)
    bits = np.zeros((len(packed), BLOCK, lane.itemsize * 8), np.uint8)
    bits[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little")[:, : BLOCK * width].reshape(len(packed), BLOCK, width)
    return np.packbits(bits, axis=2, bitorder="little").view(lane)[:, :, 0]


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of unsigned 32-bit ids; only the last may be short."""
    n = len(ids)
    if n == 0:
        return []
    rows = -(-n // BLOCK)
    full = np.full(rows * BLOCK, ids[-1], np.uint32)
    full[:n] = ids
    full = full.reshape(rows, BLOCK)
    lowest = full.min(axis=1)
    delta = full - lowest[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    widths = _widths(np.partition(delta, at, axis=1)[:, at])
    out: list[bytes] = [b""] * rows
    for width in np.unique(widths).tolist():
        group = np.flatnonzero(widths == width)
        values = delta[group]
        over = values >= 1 << width if width < 32 else np.zeros(values.shape, bool)
        packed = _pack(np.where(over, 0, values), width) if width else np.zeros((len(group), 0), np.uint8)
        who, where = np.nonzero(over)
        cuts = np.searchsorted(who, np.arange(len(group) + 1))
        outliers = values[who, where].astype("<u4")
        places = where.astype("<u2")
        for k, row in enumerate(group.tolist()):
            a, b = cuts[k], cuts[k + 1]
            count = min(BLOCK, n - row * BLOCK)
            out[row] = _HEAD.pack(int(lowest[row]), count, b - a, width) + packed[k].tobytes() + places[a:b].tobytes() + outliers[a:b].tobytes()
    return out


def unpack_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks."""
    heads = [_HEAD.unpack_from(b) for b in blocks]
    full = np.zeros((len(blocks), BLOCK), np.uint32)
    widths = np.array([h[3] for h in heads])
    for width in np.unique(widths).tolist():
        group = np.flatnonzero(widths == width)
        size = BLOCK * width // 8
        if width:
            packed = np.frombuffer(b"".join(blocks[i][_HEAD.size : _HEAD.size + size] for i in group), np.uint8).reshape(len(group), size)
            full[group] = _unpack(packed, width)
        for i in group.tolist():
            if m := heads[i][2]:
                at = _HEAD.size + size
                full[i, np.frombuffer(blocks[i], "<u2", m, at)] = np.frombuffer(blocks[i], "<u4", m, at + 2 * m)
    full += np.array([h[0] for h in heads], np.uint32)[:, None]
    counts = [h[1] for h in heads]
    if all(c == BLOCK for c in counts):
        return full.reshape(-1)
    return np.concatenate([row[:c] for row, c in zip(full, counts, strict=True)]) if blocks else np.zeros(0, np.uint32)


class TokenFileWriter:
    """Writes documents one after the other; keeps one run of ids, the index and the documents' lengths in memory."""

    def __init__(self, stream, percentile: float = PERCENTILE) -> None:
        self.stream, self.percentile = stream, percentile
        self.held: list[bytes] = []
        self.n_held = 0
        self.starts, self.lengths, self.ids = [], [], []
        self.at = stream.write(MAGIC) or len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= RUN * BLOCK:
            self._flush(False)

    def _flush(self, everything: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        stop = len(ids) if everything else len(ids) // BLOCK * BLOCK
        for at in range(0, stop, RUN * BLOCK):
            for block in pack_blocks(ids[at : min(stop, at + RUN * BLOCK)], self.percentile):
                self.starts.append(self.at)
                self.stream.write(block)
                self.at += len(block)
        self.held, self.n_held = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> dict[str, int]:
        self._flush(True)
        null = np.array([i is None for i in self.ids], np.uint8)
        end = np.array(self.starts, "<u8").tobytes() + np.array(self.lengths, "<u8").tobytes() + np.array([i or 0 for i in self.ids], "<i8").tobytes() + null.tobytes()
        total = sum(self.lengths)
        self.stream.write(end + _TAIL.pack(len(self.starts), len(self.ids), total, self.at, MAGIC))
        return {"n_docs": len(self.ids), "n_tokens": total, "n_bytes": self.at + len(end) + _TAIL.size}


class TokenFileReader:
    """Reads a file through a seekable object with ``size()``, ``seek()`` and ``read()``."""

    def __init__(self, file) -> None:
        self.file = file
        end = file.size()
        file.seek(end - _TAIL.size)
        blocks, docs, self.n_tokens, index, magic = _TAIL.unpack(file.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        file.seek(index)
        data = file.read(end - _TAIL.size - index)
        self.starts = np.append(np.frombuffer(data, "<u8", blocks), index).astype(np.int64)
        self.lengths = np.frombuffer(data, "<u8", docs, 8 * blocks).astype(np.int64)
        ids = np.frombuffer(data, "<i8", docs, 8 * (blocks + docs))
        null = np.frombuffer(data, np.uint8, docs, 8 * (blocks + 2 * docs))
        self.ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)]

    def _blocks(self, first: int, stop: int) -> np.ndarray:
        at = self.starts[first : stop + 1]
        self.file.seek(int(at[0]))
        data = self.file.read(int(at[-1] - at[0]))
        cut = (at - at[0]).tolist()
        return unpack_blocks([data[a:b] for a, b in zip(cut, cut[1:], strict=False)])

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive) of the file, reading only the blocks that hold them."""
        stop = min(stop, self.n_tokens)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = start // BLOCK
        return self._blocks(first, -(-stop // BLOCK))[start - first * BLOCK : stop - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, ids before it in the file, its ids) of each document."""
        parts: list[bytes] = []
        have, doc, begun, n_blocks = 0, 0, 0, len(self.starts) - 1
        for first in range(0, max(1, n_blocks), RUN):
            data = self._blocks(first, min(n_blocks, first + RUN)).astype("<u4").tobytes() if n_blocks else b""
            at = 0
            while doc < len(self.ids):
                need = 4 * int(self.lengths[doc]) - have
                if need > len(data) - at:
                    parts.append(data[at:])
                    have += len(data) - at
                    break
                yield self.ids[doc], begun, b"".join([*parts, data[at : at + need]])
                at += need
                begun += int(self.lengths[doc])
                parts, have, doc = [], 0, doc + 1


class FileEncoder:
    """Ids by the tokenizers library.

    Latin-1 texts are split into the vocabulary's words here (see ``words``), and the library encodes each distinct word
    that a task has not met before; all other texts, and those that may hold a special token, it encodes whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        end = bpe.read_spec(path)["model"]["end_of_word_suffix"]
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(end)]] = True
        self.table = WordTable(self._encode_new)

    def _encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._encode_some(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode_some(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words go to the library as one text; the ids that end a word part its ids."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
        counts = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
        if len(counts) != len(words):
            each = [e.ids for e in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            ids, counts = np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each])
        return ids, counts.astype(np.int64)

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        return self.table.encode_or(texts, self._ask)


_ENCODERS: dict[str, FileEncoder] = {}


def _encoder(path: str) -> FileEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = FileEncoder(path)
    return _ENCODERS[path]


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI; Hadoop writes local ones with one slash."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write their ids under ``folder``; return the manifest, a written table with one row per file:
    (shard, path, n_docs, n_tokens, n_bytes), shards in order of ids."""
    ship_package(docs.sparkSession)
    file = ship_file(docs.sparkSession, tokenizer)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = writer = None
        tokenizer = shipped(file)
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.stf"
        for batch in batches:
            for piece in slices(batch, 1, SLICE):
                if writer is None:
                    fs, where = _place(path)
                    fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
                    stream = fs.open_output_stream(where)
                    writer = TokenFileWriter(stream)
                for i, ids in zip(piece.column(0).to_pylist(), _encoder(tokenizer).encode_batch(piece.column(1).to_pylist()), strict=True):
                    writer.add(i, ids + end)
        if writer is not None:
            row = {"shard": task.partitionId(), "path": path} | writer.close()
            stream.close()
            # an idle worker keeps no words
            _encoder(tokenizer).table.forget()
            trim()
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    # the last key parts rows that are equal in the others, such as many empty texts without ids
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("n"))
    dealt = keyed.repartitionByRange("id", "h", "n").sortWithinPartitions("id", "h").select("id", "text")
    manifest = materialise(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long, n_bytes long"), "token-manifest")
    _sweep(docs.sparkSession, folder, manifest)
    return manifest


def _sweep(spark: SparkSession, folder: str, manifest: DataFrame) -> None:
    """Delete files that failed attempts left; the manifest has a row per file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where):
        known = {r["path"].rsplit("/", 1)[-1] for r in manifest.select("path").collect()}
        for found in fs.listStatus(where):
            if found.getPath().getName().endswith(".stf") and found.getPath().getName() not in known:
                fs.delete(found.getPath(), False)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files; start counts the ids of all documents before it."""
    spark = manifest.sparkSession
    ship_package(spark)
    # one row per file, as in any listing of files
    files, before = [], 0
    for r in manifest.orderBy("shard").collect():
        files.append((r["path"], before))
        before += r["n_tokens"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                fs, where = _place(row["path"])
                with fs.open_input_file(where) as file:
                    rows, held = [], 0
                    for i, start, ids in TokenFileReader(file).documents():
                        rows.append((i, row["start"] + start, len(ids) // 4, ids))
                        held += len(ids) + 64
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    table = spark.createDataFrame(files, "path string, start long").repartition(max(1, len(files)))
    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "token-files"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
