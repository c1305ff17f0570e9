"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Each text gets a 64-bit SimHash of its word shingles.  Two fingerprints differ in at most ``radius`` bits exactly if
their balls of half the radius meet, so every distinct fingerprint emits all its variants with up to radius/2 flipped
bits (65 for radius 2), the variants are shuffled, and fingerprints that meet are links.  For an even radius all pairs
in a meeting lie within it by the triangle inequality; a star from the smallest member keeps every component, and each
link is verified.  For radius 1 the variants that are fingerprints themselves are the links.  A meeting has at most 65
members, since members are distinct fingerprints around one value; so no bucket can grow with the number of copies, and
exact copies are one fingerprint from the first aggregate on.

**Similarity.**  A radius of 2 finds the closest copies only: at a Jaccard similarity of 0.8 fingerprints of 64 bits
differ in about 10.  With ``similarity`` given, candidates come from the same ball hashing over TABLES other fingerprints
for each text, in which shingles vote with heavy-tailed weights u**-TILT, u being uniform and made from shingle and
table.  A few heavy shingles decide such a fingerprint: where two texts share them, their fingerprints differ in no more
than 2 bits, so each table finds a pair with a probability that grows with its similarity.  Texts that share a
fingerprint are a bucket.  All pairs of a bucket of at most CROWD texts, and of two such that meet, are candidates.  In
larger buckets, as a passage that many texts share makes them, each text is a candidate with LEADERS others, and all texts are
also dealt anew, up to DEPTH times, by their next heaviest shingle, until it isn't of the passage and buckets are small.
Groups of copies that stay together through all of that are close to their leaders; where the verified links leave texts of such
a bucket outside of its first leader's component, those are compared with every text of the bucket that is of another component,
so no pair of the last buckets is left out.  Those are compared by their sets of shingles, part by part of a bucket within arrays, and
a pair of parts gives a link for each two components that it joins: the time is the product of both counts in the worst case, but
neither rows nor memory are.  Every other candidate is verified: by an
unweighted SimHash of SKETCH_BITS bits, whose differing share gives the angle between the sets of shingles and, with their
sizes, the Jaccard similarity (standard error 0.013 at 0.8), and exactly if both texts have at most FEW shingles, or if
the estimate is within MARGIN standard errors of ``similarity``.

Defined results for odd input: null and empty texts have fingerprint 0 and are linked like any other (by similarity: to
each other only); texts with fewer words than a shingle are one shingle; equal and null ids stay separate rows
(component_id ignores null ids and is null only where a component has no other); empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqloom.llm.batches import map_texts
from seqloom.llm.components import connected_components
from seqloom.plans.durable import join_small, materialise, scratch
from seqloom.plans.ship import ship_package

SEED = 42
SHINGLE = 3
#: Up to so many linked fingerprints (16 bytes each, their roots besides) are broadcast.
MAX_BROADCAST_LINKED = 100_000
#: A fingerprint with at least 1/HOT of all rows is hot; there are at most HOT of them.
HOT = 2000


#: Words of a shingle where documents are compared by similarity.
WORDS = 5
TABLES = 4
TILT = 2.5
#: So many of the heaviest shingles vote in a table; the others weigh less than a thousandth of the first.
HEAVIEST = 64
#: Texts of a bucket whose pairs are all candidates; others of a larger one that a text is a candidate with, at first and
#: when dealt anew; how often texts are dealt anew.
CROWD, LEADERS, DEPTH = 16, (8, 4), 8
SKETCH_BITS = 4096
FEW = 32
#: Standard errors around ``similarity`` within which the sets of shingles are compared themselves.
MARGIN = 3
#: Texts that are fetched for that by a broadcast of their ids.
MAX_BROADCAST_TEXTS = 200_000
#: Texts of a part of a bucket (an eighth of the bucket within these bounds), and shingles of one on average.
PART, PART_SHINGLES = (128, 2048), 1 << 20
_LANES = SKETCH_BITS // 64
_ODD = np.random.default_rng(42).integers(1, 1 << 62, _LANES + TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter((digest(r, SEED) for r in runs), dtype=np.uint64, count=len(words) - shingle + 1)


#: Each byte's bits as the bytes of a number, the lowest first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def _bit_counts(numbers: np.ndarray) -> np.ndarray:
    """How often each bit is set in (n, lanes) 64-bit numbers; eight bits are counted by one addition."""
    data = np.ascontiguousarray(numbers, "<u8").view(np.uint8)
    counts = np.zeros(8 * data.shape[1], np.int64)
    for at in range(0, len(data), 255):
        counts += np.add.reduce(_SPREAD[data[at : at + 255]], axis=0).view(np.uint8)
    return counts


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text, unsigned: a bit is 1 if set in more than half of the shingles' XXH64."""
    hashes = shingle_hashes(text, shingle)
    return int.from_bytes(np.packbits(_bit_counts(hashes[:, None]) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _mixed(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """(len(odd), n) numbers that look independent of each other."""
    v = hashes[None, :] * odd[:, None]
    v ^= v >> np.uint64(31)
    v *= np.uint64(0x9E3779B97F4A7C15)
    return v ^ v >> np.uint64(29)


def sketch(text: str | None, shingle: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sketch as _LANES numbers, fingerprint of each table, distinct shingles, each table's heaviest ones behind the first)
    of a text; without words no table."""
    own = np.unique(shingle_hashes(text, shingle))
    if not len(own):
        return np.zeros(_LANES, np.int64), np.zeros(0, np.int64), own, np.zeros(0, np.int64)
    counts = sum(_bit_counts(_mixed(own[at : at + 4096], _ODD[:_LANES]).T) for at in range(0, len(own), 4096))
    bits = np.packbits(counts * 2 > len(own), bitorder="little").view("<i8")
    u = _mixed(own, _ODD[_LANES:])
    best = np.argpartition(u, HEAVIEST, axis=1)[:, :HEAVIEST] if len(own) > HEAVIEST else np.broadcast_to(np.arange(len(own)), u.shape)
    u = (np.take_along_axis(u, best, 1) >> np.uint64(11)).astype(np.float64) + 1
    weights = (u / u.min(axis=1, keepdims=True)) ** -TILT
    votes = np.unpackbits(own[best].astype("<u8").view(np.uint8).reshape(TABLES, -1, 8), axis=2, bitorder="little").astype(np.float64) * 2 - 1
    keys = np.packbits((votes * weights[:, :, None]).sum(axis=1) > 0, axis=1, bitorder="little").view("<i8")[:, 0]
    order = np.take_along_axis(best, np.argsort(u, axis=1, kind="stable")[:, 1 : DEPTH + 1], 1)
    return bits, keys, own, own[order].view(np.int64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        values = np.fromiter((fingerprint(t, shingle) for t in piece.column(1).to_pylist()), dtype=np.uint64, count=piece.num_rows)
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(values.view(np.int64))], names=[id_col, "fp"])

    return map_texts(docs, [id_col, text_col], apply, f"`{id_col}` {kind}, fp long")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS) -> DataFrame:
    """(id, fp, size, sketch, keys, heavy, few): fp is the first 64 bits of the sketch, size the number of distinct shingles,
    heavy the tables' heaviest ones, table by table, few all their hashes if there are at most FEW."""
    kind = docs.schema[id_col].dataType.simpleString()
    longs = pa.list_(pa.int64())

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = [sketch(t, shingle) for t in piece.column(1).to_pylist()]
        bits, keys, own, heavy = zip(*found, strict=True)
        few = [h.view(np.int64) if len(h) <= FEW else None for h in own]
        numbers = [pa.array([int(b[0]) for b in bits], pa.int64()), pa.array(list(map(len, own)), pa.int64())]
        return pa.RecordBatch.from_arrays([piece.column(0), *numbers, *(pa.array(x, longs) for x in (bits, keys, heavy, few))], names=[id_col, "fp", "size", "sketch", "keys", "heavy", "few"])

    return map_texts(docs, [id_col, text_col], apply, f"`{id_col}` {kind}, fp long, size long, sketch array<long>, keys array<long>, heavy array<long>, few array<long>")


def _ball(fp: Column, half: int) -> Column:
    """All values within ``half`` (0 or 1) flipped bits."""
    if half == 0:
        return F.array(fp)
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints of ``classes.fp`` that keep every component of the radius.

    Radius 0 to 2: larger balls have thousands of variants.
    """
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    half = (radius + 1) // 2
    spread = classes.select("fp", F.explode(_ball(F.col("fp"), half)).alias("variant"))
    if radius == 1:  # members of a meeting may lie 2 bits apart, but a variant that is a fingerprint is a link itself
        return spread.where("fp < variant").join(classes.select(F.col("fp").alias("variant")), "variant", "left_semi").select(F.col("fp").alias("a"), F.col("variant").alias("b"))
    met = spread.repartition("variant").groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    met = materialise(met, "simhash-met")
    ends = met.select("a", "b")
    crowded = met.where("n > 2").select("a", F.explode(_ball(F.col("variant"), half)).alias("b"))
    members = crowded.join(classes.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")
    every = ends.unionByName(members).where("a <> b").distinct()
    return every.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _hot(total: int) -> int:
    return max(1000, total // HOT)


def _join_hot(rows: DataFrame, table: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with a table of unique keys; those of ``hot`` (at most HOT keys, each with 1/HOT of all rows) are broadcast.

    Both sides grow with the documents, so the rest is dealt and merged at every size.
    """
    few = table.join(F.broadcast(hot), on, "left_semi")
    often = rows.join(F.broadcast(few), on)
    rest = rows.join(F.broadcast(hot), on, "left_anti").join(table.hint("merge"), on)
    return often.unionByName(rest)


def _with_ends(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs``, which are written, with columns of ``table`` (fp, ...) for a and b; an end may be a leader of many."""
    bound = _hot(pairs.count())
    hot = {end: materialise(pairs.groupBy(end).count().where(F.col("count") >= bound).select(end), "simhash-hot") for end in ("a", "b")}
    for end, few in hot.items():
        pairs = _join_hot(pairs, table.select(F.col("fp").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), few, [end])
    return pairs


def _buckets(keyed: DataFrame) -> DataFrame:
    """(t, key, members): up to CROWD + 1 of the fingerprints of each key, in order of a hash, so any first ones are a sample.

    No more than those of a key leave a task, however many there are."""
    order = Window.partitionBy("t", "key").orderBy(F.xxhash64("fp"), "fp")
    few = keyed.select("t", "key", "fp").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= CROWD + 1)
    members = F.transform(F.sort_array(F.collect_list(F.struct("_n", "fp"))), lambda m: m["fp"])
    return materialise(few.groupBy("t", "key").agg(members.alias("members")), "simhash-buckets")


def _pairs(one: str, other: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """(a, b): all pairs of one array, or of one and another."""

    def made(rows: DataFrame) -> DataFrame:
        if other is None:
            return rows.select(F.explode(one).alias("a"), F.col(one).alias("_m")).select("a", F.explode(F.filter("_m", lambda m: m > F.col("a"))).alias("b"))
        return rows.select(F.explode(one).alias("a"), F.col(other).alias("_m")).select("a", F.explode("_m").alias("b"))

    return made


def _near(buckets: DataFrame) -> DataFrame:
    """(t, lo, hi): keys of buckets within 2 bits, by ball hashing."""
    spread = buckets.select("t", "key", F.explode(_ball(F.col("key"), 1)).alias("variant")).repartition("t", "variant")
    met = spread.groupBy("t", "variant").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).where("n > 1")
    met = materialise(met, "simhash-met")
    # a meeting of more than two: each with the smallest, and each with each by its own ball around the variant
    crowded = met.where("n > 2").select("t", "lo", F.explode(_ball(F.col("variant"), 1)).alias("hi"))
    crowded = crowded.join(buckets.select("t", F.col("key").alias("hi")).hint("merge"), ["t", "hi"], "left_semi")
    return materialise(met.select("t", "lo", "hi").unionByName(crowded.select("t", "lo", "hi")).where("lo <> hi").distinct(), "simhash-near")


def candidate_links(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, first), a < b: fingerprints of ``classes`` (fp, keys, heavy) that share or nearly share a table's fingerprint, or a
    heavy shingle where too many do; first: one end is the first leader of a crowded bucket with the other.  And (fp, t, leader),
    the members of the buckets that are crowded to the last, t and leader naming a bucket; None without any."""
    ranks = F.col("tables") * F.col("t")
    keyed = classes.select("fp", "heavy", F.posexplode("keys").alias("t", "key"), F.floor(F.size("heavy") / F.size("keys")).cast("int").alias("tables"))
    met = F.array().cast("array<struct<b: bigint, first: boolean>>").alias("met")
    keyed = keyed.select("fp", F.col("t").cast("byte").alias("t"), "key", F.slice("heavy", ranks + 1, F.col("tables")).alias("heavy"), met)
    buckets = _buckets(keyed)
    small = F.size("members") <= CROWD
    every = [_pairs("members")(buckets.where(small))]
    near = _near(buckets)
    for end in ("lo", "hi"):  # a key has at most 64 * 65 / 2 others within 2 bits
        near = near.join(buckets.select("t", F.col("key").alias(end), F.col("members").alias(f"m_{end}")).hint("merge"), ["t", end])
    sizes = {end: F.size(f"m_{end}") > CROWD for end in ("lo", "hi")}
    near = materialise(near.select("t", *[c for end in sizes for c in (end, sizes[end].alias(f"crowd_{end}"), F.when(sizes[end], F.slice(f"m_{end}", 1, 1)).otherwise(F.col(f"m_{end}")).alias(f"m_{end}"))]), "simhash-near")
    every.append(_pairs("m_lo", "m_hi")(near))
    # small buckets beside a crowded one are dealt anew with it
    beside = near.where("crowd_lo AND NOT crowd_hi").select("t", F.col("hi").alias("key")).unionByName(near.where("crowd_hi AND NOT crowd_lo").select("t", F.col("lo").alias("key"))).distinct()
    beside = beside.select("t", "key", F.array().cast("array<bigint>").alias("leaders"))
    stars: list[DataFrame] = []
    last = None
    led = F.transform("leaders", lambda b, i: F.struct(b.alias("b"), (i == 0).alias("first")))
    for level in range(DEPTH + 1):
        crowded = buckets.where(~small).select("t", "key", F.slice("members", 1, LEADERS[min(level, 1)]).alias("leaders"))
        again = materialise(crowded if level else crowded.unionByName(beside), "simhash-crowded")
        if again.isEmpty():
            break
        rows = join_small(keyed, again, ["t", "key"], F.col("fp"), "inner")
        # a group that stays together has its leaders from level to level: each is met once
        rows = rows.select("fp", "t", "key", "heavy", F.get("leaders", F.lit(0)).alias("leader"), F.array_except(led, "met").alias("new"), F.array_union(led, "met").alias("met"))
        rows = materialise(rows, "simhash-again")
        stars.append(rows.select(F.col("fp").alias("a"), F.inline("new")))
        if level < DEPTH:
            # texts without a further shingle stay together
            deeper = F.coalesce(F.get("heavy", F.lit(level)), F.xxhash64("t", "key", F.lit(level)))
            keyed = rows.select("fp", "t", deeper.alias("key"), "heavy", "met")
            buckets = _buckets(keyed)
            every.append(_pairs("members")(buckets.where(small)))
        else:
            last = rows.select("fp", "t", "leader")
    found = reduce(DataFrame.unionByName, [e.withColumn("first", F.lit(False)) for e in every] + stars).where("a <> b")
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("first").alias("first")), last


def similarity_of(pairs: DataFrame) -> Column:
    """Estimated Jaccard similarity from size, sketch and few of a and b."""
    differing = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    cosine = F.cos(F.least(differing / SKETCH_BITS, F.lit(0.5)) * math.pi)
    common = F.least(cosine * F.sqrt(F.col("size_a") * F.col("size_b")), F.least("size_a", "size_b").cast("double"))
    exact = F.size(F.array_intersect("few_a", "few_b"))
    common = F.when(F.col("few_a").isNotNull() & F.col("few_b").isNotNull(), exact.cast("double")).otherwise(common)
    return common / (F.col("size_a") + F.col("size_b") - common)


def _shared(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(a, b, similarity) of pairs of fingerprints, by the sets of shingles of one text of each."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), docs, classes, id_col, text_col, shingle)
    both = _with_ends(pairs, sets, ["own"])
    common = F.size(F.array_intersect("own_a", "own_b"))
    return both.select("a", "b", (common / (F.size("own_a") + F.size("own_b") - common)).alias("similarity"))


def _sets(ends: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(fp, own), written: the distinct shingles of one text of each of the fingerprints ``ends``."""
    wanted = materialise(classes.join(ends, "fp", "left_semi").select(F.col("first_id").alias(id_col)).distinct(), "simhash-wanted")
    texts = join_small(docs.select(id_col, text_col), wanted, [id_col], F.col(text_col), "left_semi", max_rows=MAX_BROADCAST_TEXTS)
    longs = pa.list_(pa.int64())

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = [sketch(t, shingle) for t in piece.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([int(x[0][0]) for x in found], pa.int64()), pa.array([x[2].view(np.int64) for x in found], longs)], names=["fp", "own"])

    sets = map_texts(texts, [id_col, text_col], apply, "fp long, own array<long>")
    return materialise(sets.join(ends.hint("merge"), "fp", "left_semi").groupBy("fp").agg(F.first("own").alias("own")), "simhash-sets")


def similar_links(classes: DataFrame, similarity: float, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(a, b): candidates whose similarity is verified, enough of them to keep every component.

    The first leaders' links come first; of the others those whose ends they have joined already add nothing and are not
    verified, so a large group of copies costs a few links for each copy.
    """
    cosine = 2 * similarity / (1 + similarity)
    share = math.acos(cosine) / math.pi
    # the first 64 bits of the sketches, which are at hand, leave out what is far from similar: five standard errors off
    most = math.ceil(64 * share + 5 * math.sqrt(64 * share * (1 - share)))
    pairs, last = candidate_links(classes.where("size > 0"))
    pairs = materialise(pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most), "simhash-pairs")

    def verified(some: DataFrame) -> DataFrame:
        return materialise(_verified(some, classes, similarity, docs, id_col, text_col, shingle), "simhash-links")

    stars, rest = pairs.where("first").select("a", "b"), pairs.where("NOT first").select("a", "b")
    if stars.isEmpty():
        return verified(rest)
    found = verified(stars)
    rest = _with_roots(rest, _roots(found), ["a", "b"])
    open_ = materialise(rest.where("root_a <> root_b").select("a", "b"), "simhash-open")
    found = found.unionByName(verified(open_))
    if last is None:
        return found
    outside = _outside_links(last, found, similarity, docs, classes, id_col, text_col, shingle)
    return found if outside is None else found.unionByName(outside)


def _roots(found: DataFrame) -> DataFrame:
    return materialise(connected_components(found, "a", "b"), "simhash-roots")


def _with_roots(rows: DataFrame, roots: DataFrame, ends: list[str]) -> DataFrame:
    """``rows`` with the root of the fingerprint in each column of ``ends``."""
    few = roots.count() <= MAX_BROADCAST_LINKED
    for end in ends:
        own = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        rows = rows.join(F.broadcast(own) if few else own, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return rows


def _outside(last: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """(a, b): texts of ``last`` (fp, t, leader) outside of their first leader's component, with all of the same bucket that are of another
    component than they are and within ``most`` of the first 64 bits; by all pairs, kept to compare with."""
    own = materialise(_with_roots(last, _roots(found), ["fp", "leader"]), "simhash-last")
    out = materialise(own.where("root_fp <> root_leader").select("t", "leader", F.col("fp").alias("b"), F.col("root_fp").alias("root_b")), "simhash-out")
    met = join_small(own.select("t", "leader", F.col("fp").alias("a"), F.col("root_fp").alias("root_a")), out, ["t", "leader"], F.col("a"), "inner")
    met = met.where((F.col("root_a") != F.col("root_b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most))
    return materialise(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-outside")


def _outside_links(last: DataFrame, found: DataFrame, similarity: float, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame | None:
    """(a, b): links of texts of ``last`` (fp, t, leader) outside of their first leader's component with texts of the same bucket that
    are of another component, enough of them to keep every component; None without such texts.

    Each part of the texts outside meets each part of the bucket in a group of its own, whose size doesn't grow with the bucket.
    """
    own = _with_roots(last, _roots(found), ["fp", "leader"])
    own = materialise(own.select("t", "leader", "fp", F.col("root_fp").alias("root"), (F.col("root_fp") != F.col("root_leader")).alias("asks")), "simhash-last")
    open_ = materialise(own.where("asks").select("t", "leader").distinct(), "simhash-out")
    if open_.isEmpty():
        return None
    own = join_small(own, open_, ["t", "leader"], F.col("fp"), "left_semi")
    sets = _sets(own.select("fp").distinct(), docs, classes, id_col, text_col, shingle)
    held = materialise(own.join(sets.hint("merge"), "fp"), "simhash-held")

    def parts(rows: DataFrame, name: str) -> DataFrame:
        n, shingles = F.count("*"), F.sum(F.size("own"))
        texts = F.least(F.greatest(n / 8, F.lit(PART[0])), F.lit(PART[1]))
        return rows.groupBy("t", "leader").agg(F.ceil(F.greatest(n / texts, shingles / PART_SHINGLES)).alias(name))

    sizes = materialise(parts(held.where("asks"), "n_asking").join(parts(held, "n_all"), ["t", "leader"]), "simhash-parts")
    rows = join_small(held, sizes, ["t", "leader"], F.col("fp"), "inner")

    def side(rows: DataFrame, asks: bool, own_part: tuple[str, str], copied: tuple[str, str]) -> DataFrame:
        at = F.pmod(F.xxhash64("fp"), own_part[1]).alias(own_part[0])
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copied[1]) - 1)).alias(copied[0])
        return rows.select("t", "leader", "fp", "root", "own", F.lit(asks).alias("asks"), at, copies)

    asking, every = ("i", "n_asking"), ("j", "n_all")
    met = side(rows.where("asks"), True, asking, every).unionByName(side(rows, False, every, asking))

    def compare(table: pa.Table) -> pa.Table:
        return _joining(table, similarity)

    ship_package(docs.sparkSession)
    return materialise(met.groupBy("t", "leader", "i", "j").applyInArrow(compare, "a long, b long"), "simhash-outside")


def _joining(table: pa.Table, similarity: float) -> pa.Table:
    """(a, b): pairs of a text that asks and another of at least ``similarity``, one for each two components that are joined; rows
    are (fp, root, own, asks), root naming the component."""
    table = table.take(np.argsort(table.column("asks").to_numpy(), kind="stable"))
    fp, root = (table.column(c).to_numpy() for c in ("fp", "root"))
    others = table.num_rows - int(table.column("asks").to_numpy().sum())
    sets = [np.asarray(x, np.int64) for x in table.column("own").to_numpy()]
    parent: dict[int, int] = {}

    def top(r: int) -> int:
        while (up := parent.get(r, r)) != r:
            parent[r] = parent.get(up, up)
            r = up
        return r

    joined = []
    if others:
        sizes = np.array([len(x) for x in sets])
        ends = np.cumsum(sizes)
        numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
        rest, begins = numbers[: ends[others - 1]], (ends - sizes)[:others]
        there = np.zeros(len(numbers), bool)
        for x in range(others, len(fp)):
            mine = numbers[ends[x] - sizes[x] : ends[x]]
            there[mine] = True
            common = np.add.reduceat(there[rest], begins, dtype=np.int64)
            there[mine] = False
            near = np.flatnonzero(common / (sizes[x] + sizes[:others] - common) >= similarity)
            for y in near[np.unique(root[near], return_index=True)[1]]:
                one, other = top(int(root[x])), top(int(root[y]))
                if one != other:
                    parent[one] = other
                    joined.append((min(fp[x], fp[y]), max(fp[x], fp[y])))
    return pa.table([pa.array([j[i] for j in joined], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _verified(pairs: DataFrame, classes: DataFrame, similarity: float, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(a, b) of those pairs of fingerprints whose texts have at least ``similarity``."""
    cosine = 2 * similarity / (1 + similarity)
    share = math.acos(cosine) / math.pi
    error = 2 / (2 - cosine) ** 2 * math.pi * math.sin(math.pi * share) * math.sqrt(share * (1 - share) / SKETCH_BITS)
    both = _with_ends(pairs, classes, ["size", "sketch", "few"])
    exact = F.col("few_a").isNotNull() & F.col("few_b").isNotNull()
    least = F.when(exact, similarity).otherwise(similarity - MARGIN * error)
    told = materialise(both.select("a", "b", exact.alias("exact"), similarity_of(both).alias("similarity"), least.alias("least")).where("similarity >= least"), "simhash-told")
    sure = F.col("exact") | (F.col("similarity") > similarity + MARGIN * error)
    found, left = told.where(sure).select("a", "b"), told.where(~sure).select("a", "b")
    if left.isEmpty():
        return found
    open_ = _shared(left, docs, classes, id_col, text_col, shingle)
    return found.unionByName(open_.where(F.col("similarity") >= similarity).select("a", "b"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int, shingle: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """(prints, known), both written: prints has (id, fp) of each document, known a row per fingerprint: (fp, n, root, component_id).

    root is the smallest fingerprint of the component and never null.
    """
    grouped = [F.min(id_col).alias("first_id"), F.count("*").alias("n")]
    if similarity is None:
        prints = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
        classes = materialise(prints.groupBy("fp").agg(*grouped), "simhash-classes")
        found = links(classes, radius)
    else:
        prints = materialise(sketches(docs, id_col, text_col, shingle), "simhash-fp")
        wide = prints.groupBy("fp").agg(*grouped, F.min(F.struct("size", "sketch", "keys", "heavy", "few")).alias("s"))
        classes = materialise(wide.select("fp", "first_id", "n", "s.*"), "simhash-classes")
        found = similar_links(classes, similarity, docs, id_col, text_col, shingle)
        classes = classes.select("fp", "first_id", "n")
    roots = materialise(connected_components(found, "a", "b"), "simhash-roots")
    # fingerprints with links, the roots among them; a component may hold many, so its root is never a plain join key
    few = roots.count() <= MAX_BROADCAST_LINKED
    dealt = roots.coalesce(1) if few else roots
    linked = dealt.unionByName(dealt.select(F.col("root").alias("node"), "root").distinct())
    # unique fingerprints on both sides; a counted table is broadcast
    linked = materialise(classes.join(F.broadcast(linked) if few else linked, F.col("fp") == F.col("node")).select("node", "root", "first_id"), "simhash-linked")
    dealt = linked.coalesce(1) if few else linked
    smallest = materialise(dealt.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-smallest")
    named = join_small(linked, smallest, ["root"], F.col("node")).select(F.col("node").alias("fp"), "root", "component_id")
    named = F.broadcast(named) if few else named
    component = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("first_id"))
    known = classes.join(named, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), component.alias("component_id"))
    return prints, materialise(known, "simhash-components")


def _with_component(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows``, which have a fingerprint fp, with root and component_id."""
    columns = ["fp", "root", "component_id"]
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") >= _hot(total)
    few = known.where(hot).select(*columns)  # at most HOT rows, as each holds 1/HOT of all
    often = rows.join(F.broadcast(few), "fp")
    rest = rows.join(F.broadcast(few.select("fp")), "fp", "left_anti").join(known.where(~hot).select(*columns), "fp")
    return often.unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int | None = None, similarity: float | None = None) -> DataFrame:
    """One row per document: (id, fp, component_id), component_id being the smallest id reachable over links.

    Links are fingerprints within ``radius`` bits, or with ``similarity`` documents of at least that Jaccard similarity of
    their sets of shingles; a shingle has SHINGLE or WORDS words unless given.
    """
    shingle = shingle or (SHINGLE if similarity is None else WORDS)
    with scratch(docs.sparkSession) as own:
        prints, known = _grouped(docs, id_col, text_col, radius, shingle, similarity)
        own.keep(prints, known)
    return _with_component(prints.select(id_col, "fp"), known).select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int | None = None, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id; options as in ``near_duplicates``.

    Where several rows of a group have that id, or none has an id, the smallest of them in the order of the columns
    stays.  An id may stand for rows of several groups; each group keeps its own.
    """
    shingle = shingle or (SHINGLE if similarity is None else WORDS)
    with scratch(docs.sparkSession) as own:
        prints, known = _grouped(docs, id_col, text_col, radius, shingle, similarity)
        found = _with_component(prints.select(id_col, "fp"), known)
        chosen = found.groupBy(F.col(id_col).alias("_sl_id")).agg(F.count("*").alias("_sl_n"), F.max(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("_sl_kept"))
        chosen = materialise(chosen.where("_sl_kept").select("_sl_id", "_sl_n"), "simhash-kept")
        own.keep(known, chosen)
    # texts are dealt by id at every size: the kept ids grow with the documents and are no table to broadcast
    single = chosen.where("_sl_n = 1").select("_sl_id").hint("merge")
    once = docs.join(single, F.col(id_col).eqNullSafe(F.col("_sl_id")), "left_semi").select(*docs.columns)
    more = chosen.where("_sl_n > 1").select("_sl_id")
    if more.isEmpty():
        return once
    # rows that their id doesn't tell apart are decided one by one, by the group of their own text
    again = join_small(docs, more.withColumnRenamed("_sl_id", id_col), [id_col], F.col(text_col), "inner").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_sl_row"), F.col(text_col).alias("_sl_text"))
    rows = _with_component(_row_prints(again, _print_of(shingle, similarity)), known).where(F.col("_sl_row")[id_col].eqNullSafe(F.col("component_id")))
    first = rows.groupBy("root").agg(F.min("_sl_row").alias("_sl_row"))
    return once.unionByName(first.select(*[F.col("_sl_row")[c].alias(c) for c in docs.columns]))


def _print_of(shingle: int, similarity: float | None) -> Callable[[str | None], int]:
    """The signed fingerprint of a text by which ``_grouped`` tells classes apart."""
    if similarity is not None:
        return lambda text: int(sketch(text, shingle)[0][0])
    return lambda text: int(np.uint64(fingerprint(text, shingle)).view(np.int64))


def _row_prints(rows: DataFrame, print_of: Callable[[str | None], int]) -> DataFrame:
    """(_sl_row, fp) from (_sl_row, _sl_text)."""

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array([print_of(t) for t in piece.column(1).to_pylist()], pa.int64())], names=["_sl_row", "fp"])

    return map_texts(rows, ["_sl_row", "_sl_text"], apply, StructType([rows.schema["_sl_row"], StructField("fp", LongType())]))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
