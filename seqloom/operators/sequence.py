"""Concatenated sequences as tables.

``records`` are (ord, id, seq); ``contigs`` add n and off, the bases before a record.  A sequence is a table of
``pieces`` (pos, bases) that cover it without gaps, in any order; no row holds more than one input row did.  ``blocks`` cut
pieces into even parts with a look-ahead, so that k-mers never need a neighbouring row.

K-mers are strings, or numbers of two bits a base (``packed_kmers``), which are made block by block from Arrow batches: a
third of the bytes to shuffle and compare, and three times as fast to make and count as the strings of built-in functions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.bases import PACKED, contains_n, cut, reverse_complement
from seqloom.plans.durable import materialise
from seqloom.plans.ship import ship_package

#: Bases of a block.
BLOCK = 4096
#: Blocks that are packed together, and the longest words that fit into a number.
TOGETHER = 256
MAX_PACKED = 31


def with_offsets(records: DataFrame, ord_col: str = "ord", n_col: str = "n") -> DataFrame:
    """``records`` with ``off``, the exclusive running sum of n by ord, without a window over all rows.

    Rows are dealt by ranges of their order, whatever the values of ord are, and written, so that each range is summed
    in a task of its own and only the ranges' sums, a row each, are ordered as a whole.  Equal values of ord are ordered by
    id, n and seq, as far as there are such columns, and rows that are equal in these by chance, so no value has to be one
    task's; rows without an ord come last, in order of the MD5 of their id.
    """
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))) if "id" in records.columns else F.md5(F.lit(""))
    ties = [F.col(c) for c in ("id", n_col) if c in records.columns] + ([F.xxhash64("seq")] if "seq" in records.columns else [])
    order = [F.col(ord_col).asc_nulls_last(), F.col("_rank").asc_nulls_first(), *ties, F.col("_row")]
    rows = records.withColumns({"_rank": F.when(F.col(ord_col).isNull(), digest), "_row": F.monotonically_increasing_id()})
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(F.col("_range").alias("_of")).agg(F.sum(n_col).alias("_s")).select("_of", F.coalesce(F.sum("_s").over(across), F.lit(0)).alias("_base"))
    placed = ranged.withColumn("_inside", F.coalesce(F.sum(n_col).over(inside), F.lit(0)))
    joined = placed.join(F.broadcast(sums), F.col("_range") == F.col("_of"))  # a row for each range
    return joined.withColumn("off", (F.col("_base") + F.col("_inside")).cast("long")).drop("_rank", "_row", "_range", "_of", "_base", "_inside")


def contigs_of(records: DataFrame) -> DataFrame:
    """(ord, id, seq, n, off)."""
    return with_offsets(records.withColumn("n", F.length("seq").cast("long")))


def pieces_of(contigs: DataFrame) -> DataFrame:
    """All records one after the other."""
    return contigs.where("n > 0").select(F.col("off").alias("pos"), F.col("seq").alias("bases"))


def slice_pieces(pieces: DataFrame, start: int, end: int) -> DataFrame:
    """Bases start to end (exclusive), counted from 0 again; what lies past the data is left out."""
    size = F.length("bases")
    lo, hi = F.greatest(F.col("pos"), F.lit(start)), F.least(F.col("pos") + size, F.lit(end))
    return pieces.where((F.col("pos") < end) & (F.col("pos") + size > start)).select((lo - start).alias("pos"), cut(F.col("bases"), lo - F.col("pos"), hi - lo).alias("bases"))


def reverse_complement_pieces(pieces: DataFrame, length: Column | int) -> DataFrame:
    size = F.lit(length) if isinstance(length, int) else length
    return pieces.select((size - F.col("pos") - F.length("bases")).alias("pos"), reverse_complement(F.col("bases")).alias("bases"))


def length_of(pieces: DataFrame) -> int:
    return pieces.agg(F.coalesce(F.max(F.col("pos") + F.length("bases")), F.lit(0))).first()[0]


def blocks_of(pieces: DataFrame, look: int = 0, size: int = BLOCK, only: DataFrame | None = None) -> DataFrame:
    """(start, n, bases): block b holds bases b * size on, ``n`` of its own and up to ``look`` of the next blocks; with ``only``
    (block) no others are made."""
    n = F.length("bases")
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - look) / size))
    last = F.floor((F.col("pos") + n - 1) / size)
    parts = pieces.where(n > 0).select("pos", "bases", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("pos"), F.col("block") * size)
    hi = F.least(F.col("pos") + F.length("bases"), F.col("block") * size + size + look)
    parts = parts.select("block", F.struct(lo.alias("at"), cut(F.col("bases"), lo - F.col("pos"), hi - lo).alias("part")).alias("p")).where(F.length("p.part") > 0)
    if only is not None:  # dealt by block as the parts are, or broadcast, which leaves the other parts where they lie
        parts = parts.join(only, "block", "left_semi")
    # at most size + look parts, as each holds a base
    joined = parts.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "").alias("bases"))
    return joined.select((F.col("block") * size).alias("start"), F.least(F.lit(size), F.length("bases")).alias("n"), "bases")


def kmers(pieces: DataFrame, k: int, skip_n: bool = True, size: int = BLOCK) -> DataFrame:
    """(pos, kmer) of every k-mer of a sequence; those that hold an N are left out with ``skip_n``."""
    blocks = blocks_of(pieces, k - 1, size)
    count = F.least(F.col("n"), F.length("bases") - (k - 1))
    packed = blocks.where(count > 0).select("start", count.cast("int").alias("count"), F.col("bases").cast("binary").alias("raw"))
    every = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.struct((F.col("start") + i).alias("pos"), F.substr(F.col("raw"), i + 1, F.lit(k)).cast("string").alias("kmer")))
    found = packed.select(F.inline(every))
    return found.where(~contains_n(F.col("kmer"))) if skip_n else found


_CODES = np.full(256, 255, np.uint8)
_CODES[list(PACKED.encode())] = range(4)
_CODES[ord("N")] = 4


def _packed(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """(pos, kmer) of the blocks (start, n, bases, ...) of a batch, and what else their rows hold."""
    texts = [t.encode() for t in batch.column(2).to_pylist()]
    sizes, own = np.array([len(t) for t in texts]), batch.column(1).to_numpy()
    codes = _CODES[np.frombuffer(b"".join(texts), np.uint8)]
    if (codes == 255).any():
        raise ValueError("packed words are of upper-case A, C, G, T and N")
    counts = np.clip(np.minimum(own, sizes - (k - 1)), 0, None)
    begins, firsts = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    inside = np.arange(int(counts.sum())) - np.repeat(firsts, counts)
    at = inside + np.repeat(begins, counts)
    unknown = np.concatenate([[0], np.cumsum(codes == 4)])
    known = unknown[at + k] == unknown[at]
    at = at[known]
    words = np.zeros(max(0, len(codes) - k + 1), np.int64)
    for i in range(k if len(at) else 0):
        words = words << 2 | codes[i : i + len(words)]
    pos = (np.repeat(batch.column(0).to_numpy(), counts) + inside)[known]
    rest = [c.take(pa.array(np.repeat(np.arange(batch.num_rows), counts)[known])) for c in batch.columns[3:]]
    return pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(words[at], pa.int64()), *rest], names=["pos", "kmer", *batch.schema.names[3:]])


def _packed_blocks(blocks: DataFrame, k: int, schema: str) -> DataFrame:
    """Words of blocks (start, n, bases, ...) of upper-case bases."""
    if not 1 <= k <= MAX_PACKED:
        raise ValueError(f"packed words have 1 to {MAX_PACKED} bases")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield _packed(batch.slice(at, TOGETHER), k)

    ship_package(blocks.sparkSession)
    return blocks.mapInArrow(run, schema)


def record_words(records: DataFrame, k: int, key: str = "ord", size: int = BLOCK) -> DataFrame:
    """(pos, kmer, key) of every k-mer without an N inside of each record (key, seq); none spans two records, pos is counted
    within the record.  A record is cut where it lies, so nothing is shuffled."""
    kind = records.schema[key].dataType.simpleString()
    n = F.length("seq")
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k, F.lit(size))).otherwise(F.array().cast("array<int>"))
    cuts = records.select(F.upper("seq").alias("seq"), F.col(key).alias("_key"), F.explode(starts).alias("start"))
    bases = cut(F.col("seq"), F.col("start"), size + k - 1)
    blocks = cuts.select(F.col("start").cast("long").alias("start"), F.lit(size).cast("long").alias("n"), bases.alias("bases"), F.col("_key").alias(key))
    return _packed_blocks(blocks, k, f"pos long, kmer long, `{key}` {kind}")


def packed_kmers(pieces: DataFrame, k: int, size: int = BLOCK) -> DataFrame:
    """(pos, kmer) of every k-mer without an N of an upper-case sequence; kmer is a BIGINT, see ``bases.kmer_text``."""
    blocks = blocks_of(pieces, k - 1, size).select("start", F.col("n").cast("long").alias("n"), "bases")
    return _packed_blocks(blocks, k, "pos long, kmer long")


def words(pieces: DataFrame, k: int, upper: bool = True) -> DataFrame:
    """(pos, kmer) to join and count by: packed where k allows and all letters are known to be in upper case."""
    return packed_kmers(pieces, k) if upper and k <= MAX_PACKED else kmers(pieces, k)


def _counted(kmer: np.ndarray, tile: np.ndarray, n: np.ndarray | None, s: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Rows ordered by (kmer, tile), with those of equal ones summed."""
    if not len(kmer):
        return kmer, tile, n, s
    bits = int(tile.max()).bit_length()
    order = np.argsort(kmer << bits | tile) if int(kmer.max()).bit_length() + bits < 63 else np.lexsort((tile, kmer))
    kmer, tile = kmer[order], tile[order]
    first = np.flatnonzero(np.concatenate([[True], (kmer[1:] != kmer[:-1]) | (tile[1:] != tile[:-1])]))
    return kmer[first], tile[first], *(None if a is None else np.add.reduceat(a[order], first) for a in (n, s))


def word_parts(pieces: DataFrame, k: int, tile: int, parts: int, size: int = BLOCK) -> DataFrame:
    """(part, kmer, tile, n, s): the words without an N of an upper-case sequence, dealt over ``parts`` by k-mer, as arrays of
    BIGINTs (``whole_words`` reads them): n copies begin in the tile at positions that sum to s.  Blocks that are packed together
    give a row for each part."""
    if not 1 <= k <= MAX_PACKED:
        raise ValueError(f"packed words have 1 to {MAX_PACKED} bases")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                found = _packed(batch.slice(at, TOGETHER), k)
                pos, kmer = (found.column(i).to_numpy() for i in (0, 1))
                rows = _counted(kmer, pos // tile, np.ones(len(pos), np.int64), pos)
                part = ((rows[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
                held = np.flatnonzero(ends[1:] > ends[:-1])
                cut = [[a[ends[p] : ends[p + 1]].tobytes() for p in held] for a in (r[order] for r in rows)]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *(pa.array(c, pa.binary()) for c in cut)], names=["part", "kmer", "tile", "n", "s"])

    blocks = blocks_of(pieces, k - 1, size).select("start", F.col("n").cast("long").alias("n"), "bases")
    ship_package(blocks.sparkSession)
    return blocks.mapInArrow(run, "part int, kmer binary, tile binary, n binary, s binary")


def whole_words(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(kmer, tile, n, s) of a part of ``word_parts``, in order, a row for each word and tile; n and s if the rows hold them."""
    held = list(batches)
    arrays = (np.frombuffer(b"".join(x for b in held for x in b.column(c).to_pylist()), np.int64) if not held or c in held[0].schema.names else None for c in ("kmer", "tile", "n", "s"))
    return _counted(*arrays)


def bases_at(sites: DataFrame, pieces: DataFrame, size: int = BLOCK) -> DataFrame:
    """``sites`` (pos, ...) with ``base``, null outside of the sequence."""
    wanted = sites.select(F.floor(F.col("pos") / size).alias("block")).distinct()
    blocks = blocks_of(pieces, 0, size, wanted).select(F.col("start").alias("_start"), "bases")
    joined = sites.join(blocks, F.floor(F.col("pos") / size) * size == F.col("_start"), "left")
    base = cut(F.col("bases"), F.col("pos") - F.col("_start"), 1)
    return joined.withColumn("base", F.when(base != "", base)).drop("_start", "bases")


def cytosine_positions(pieces: DataFrame) -> DataFrame:
    """(pos) of every C."""
    blocks = blocks_of(pieces)
    every = F.filter(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.substr(F.col("bases").cast("binary"), i + 1, F.lit(1)) == F.lit(b"C"))
    return blocks.select(F.explode(F.transform(every, lambda i: F.col("start") + i)).alias("pos"))
