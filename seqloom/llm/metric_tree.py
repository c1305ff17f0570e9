"""Exact top-k search by inner product: an M-tree of paged metric nodes, searched best first.

Inner products become distances by one more component: with M the largest norm of all vectors, v' = (v, sqrt(M**2 - |v|**2))
and q' = (q, 0), |q' - v'|**2 = |q|**2 + M**2 - 2 q.v, so the nearest of the v' have the highest products.  All v' lie
on a sphere, their distances obey the triangle inequality, and an M-tree indexes them.

**Index.**  Equal vectors are one entry that keeps its k + 1 smallest (id, row), which is all that a result can hold of
them; salts first, so that a vector with a third of all rows meets many tasks.  Entries are dealt to the nearest of at most
MAX_PIVOTS sampled pivots, regions of more than SHARD entries over several shards; a shard's tree is loaded in bulk by
one task.  A page is a row of a table: its entries' vectors, covering radii, distances to the page's routing object (its
parent), children or ids.

**Search.**  A query goes to its nearest region first, then to each other one whose ball comes as near as its k-th result.
Within a shard a heap gives the page with the smallest bound; an entry whose stored distance to the parent and covering
radius tell that it is too far is left out before its product is computed, and the search ends when the heap's
bound exceeds the k-th distance.  Products are exact (integers); bounds are kept a slack of 1e-6 of the norms apart, far
beyond rounding.  Shards meet queries in blocks of at most BLOCK, by a shuffle; no task gets more than one shard and one block.

Defined results for odd input: vectors that are null, or hold a null or a component that isn't finite, take no part;
nor do those whose components' squares sum to 2**62 or more, as their products are no BIGINT.  A shorter vector counts as
followed by zeros (a shard's memory goes by its longest vector).  Rows with a null id are candidates, after all others in
ties, and no queries.  Repeated rows and ids are separate candidates and queries, each query leaving out its own row only.
Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.plans.durable import materialise, scratch
from seqloom.plans.ship import ship_package

#: Entries of a page, children of an inner one at first, entries of a shard, queries of a block.
PAGE, FANOUT, SHARD, BLOCK = 512, 16, 8192, 8192
MAX_PIVOTS = 1024
#: Tasks that the copies of one vector are dealt over before they are one entry.
SALTS = 32
#: Fixed value: largest norm (squared) whose products are exact in floating point.
EXACT = 1 << 53
_LAST = (1 << 63) - 1

PAGES = "region int, shard int, page int, leaf boolean, dim int, vectors binary, radii binary, to_parent binary, children binary, starts binary, ids binary, rows binary"
FOUND = "qrow long, query_id long, vec_id long, vrow long, score long"


def quantised(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(row, id, v, norm): v holds floor(scale * x) of each component; rows that take no part are left out.  ``row`` tells
    rows apart once this is written."""
    vec = F.col(vec_col)
    good = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.when(good, vec).alias("x")).where("x IS NOT NULL")
    return rows.select("row", "id", F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")).withColumn("norm", square).where(F.col("norm") < float(1 << 62))


def _first(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("id").asc_nulls_last(), "row")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(v, norm, ids, rows): a row for each distinct vector, with its k + 1 smallest (id, row); a null id counts as the largest."""
    keyed = rows.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod("row", F.lit(SALTS)))
    few = _first(_first(keyed, ["h", "v", "salt"], k + 1), ["h", "v"], k + 1)
    own = F.sort_array(F.collect_list(F.struct(F.coalesce("id", F.lit(_LAST)).alias("id"), "row")))
    return few.groupBy("h", "v").agg(F.first("norm").alias("norm"), own.alias("own")).select("v", "norm", F.col("own.id").alias("ids"), F.col("own.row").alias("rows"))


def matrix(lists: pa.ListArray | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """Vectors as rows, followed by zeros up to ``dim`` or the longest one."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values, most = lists.flatten().to_numpy(), max(int(sizes.max(initial=0)), dim or 0)
    if len(sizes) and (sizes == most).all():
        return values.reshape(len(sizes), most)
    out = np.zeros((len(sizes), most), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _numbers(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors in the type whose products are exact: floating point (fast) or integers."""
    return vectors.astype(np.float64) if largest < EXACT else vectors


def _lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """The v' of vectors whose largest norm (squared) is ``largest``."""
    v = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(0, largest - (v * v).sum(axis=1)))
    return np.concatenate([v, rest[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) distances of lifted vectors."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, square))


@dataclass
class Page:
    """A node: in a leaf the radii are 0 and ``children`` are its entries' numbers."""

    leaf: bool
    vectors: np.ndarray
    radii: np.ndarray
    to_parent: np.ndarray
    children: np.ndarray


def load_pages(vectors: np.ndarray, largest: float, page: int = PAGE, fanout: int = FANOUT, seed: int = 0) -> list[Page]:
    """A tree over distinct vectors, loaded in bulk: the first page is the root, whose entries have no parent."""
    lifted, rng = _lifted(vectors, largest), np.random.default_rng(seed)
    pages: list[Page | None] = [None]
    todo: list[tuple[int, np.ndarray, int | None]] = [(0, np.arange(len(vectors)), None)]
    while todo:
        at, own, routing = todo.pop()
        leaf = len(own) <= page
        if leaf:
            objects, radii, children = own, np.zeros(len(own)), own
        else:
            objects = np.sort(rng.choice(own, min(fanout, max(2, 2 * len(own) // page)), replace=False))
            away = _distances(lifted[own], lifted[objects])
            away[np.searchsorted(own, objects), np.arange(len(objects))] = 0
            nearest = away.argmin(axis=1)
            radii = np.array([away[nearest == i, i].max() for i in range(len(objects))])
            children = np.arange(len(pages), len(pages) + len(objects))
            todo += [(int(c), own[nearest == i], int(o)) for i, (c, o) in enumerate(zip(children, objects, strict=True))]
            pages += [None] * len(objects)
        to_parent = np.zeros(len(objects)) if routing is None else _distances(lifted[objects], lifted[routing : routing + 1])[:, 0]
        pages[at] = Page(leaf, vectors[objects], radii, to_parent, children)
    return pages


class Tree:
    """Best-first search of one shard.  ``starts`` cut ids and rows (both sorted within an entry) by entry."""

    def __init__(self, pages: list[Page], largest: float, starts: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.pages = [Page(p.leaf, _numbers(p.vectors, largest), p.radii, p.to_parent, p.children) for p in pages]
        self.largest, self.starts, self.ids, self.rows = largest, starts, ids, rows
        #: Products that searches have computed.
        self.computed = 0

    def search(self, query: np.ndarray, k: int, own_row: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, ids, rows) of the k best in order, without ``own_row`` and those below ``least``."""
        q = _numbers(query, self.largest)
        square = float((query.astype(np.float64) ** 2).sum())
        base = square + self.largest
        slack = 1e-6 * (1 + math.sqrt(square) + math.sqrt(self.largest))
        scores, ids, rows = (np.zeros(0, np.int64) for _ in range(3))
        bound = -_LAST if least is None else least
        reach = math.inf if least is None else math.sqrt(max(0.0, base - 2 * least)) + slack
        heap: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
        while heap:
            nearest, number, to_query = heapq.heappop(heap)
            if nearest > reach:
                break
            page = self.pages[number]
            vectors, at = page.vectors, None
            if to_query >= 0 and reach < math.inf:
                near = np.abs(page.to_parent - to_query) <= page.radii + reach
                if not near.all():
                    at = np.flatnonzero(near)
                    if not len(at):
                        continue
                    vectors = vectors[at]
            products = vectors @ q
            self.computed += len(products)
            if page.leaf:
                good = np.flatnonzero(products >= bound)
                if not len(good):
                    continue
                found = page.children[good if at is None else at[good]]
                first, n = self.starts[found], self.starts[found + 1] - self.starts[found]
                where = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                where, score = where[keep := self.rows[where] != own_row], np.repeat(products[good].astype(np.int64), n)[keep]
                scores, ids, rows = (np.concatenate(x) for x in ((scores, score), (ids, self.ids[where]), (rows, self.rows[where])))
                best = np.lexsort((rows, ids, -scores))[:k]
                scores, ids, rows = scores[best], ids[best], rows[best]
                if len(scores) == k and scores[-1] > bound:
                    bound = int(scores[-1])
                    reach = math.sqrt(max(0.0, base - 2 * bound)) + slack
            else:
                away = np.sqrt(np.maximum(0, base - 2 * products))
                radii, children = (page.radii, page.children) if at is None else (page.radii[at], page.children[at])
                lowest = np.maximum(0, away - radii)
                for i in np.flatnonzero(lowest <= reach).tolist():
                    heapq.heappush(heap, (float(lowest[i]), int(children[i]), float(away[i])))
        return scores, ids, rows


@dataclass(frozen=True)
class Index:
    """``pages`` (PAGES) and ``regions`` (region, shards, radius) are tables; pivots are at most MAX_PIVOTS vectors."""

    pages: DataFrame
    regions: DataFrame
    pivots: np.ndarray
    radii: np.ndarray
    largest: float


def _shard(region: int, shard: int, table: pa.Table, largest: float, page: int) -> pa.Table:
    """The pages of one shard's entries (v, ids, rows)."""
    table = table.sort_by([("first_row", "ascending")])  # the order in which rows come doesn't count
    vectors = matrix(table.column("v"))
    ids, rows = table.column("ids").combine_chunks(), table.column("rows").combine_chunks()
    starts, flat_ids, flat_rows = ids.offsets.to_numpy().astype(np.int64), ids.flatten().to_numpy(), rows.flatten().to_numpy()
    starts = starts - starts[0]
    out = []
    for number, p in enumerate(load_pages(vectors, largest, page)):
        held = [b"", b"", b""]
        if p.leaf:
            n = starts[p.children + 1] - starts[p.children]
            where = np.repeat(starts[p.children] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            held = [np.concatenate([[0], np.cumsum(n)]).astype(np.int64).tobytes(), flat_ids[where].tobytes(), flat_rows[where].tobytes()]
        children = b"" if p.leaf else p.children.astype(np.int64).tobytes()
        out.append((region, shard, number, p.leaf, vectors.shape[1], p.vectors.astype(np.int64).tobytes(), p.radii.tobytes(), p.to_parent.tobytes(), children, *held))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 7]
    names = [c.split()[0] for c in PAGES.split(", ")]
    return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def tree_of(table: pa.Table, largest: float) -> Tree:
    """The tree whose pages a table holds."""
    table = table.sort_by([("page", "ascending")])
    pages, starts, ids, rows, seen = [], [np.zeros(1, np.int64)], [], [], 0
    for p in table.to_pylist():
        radii, to_parent = np.frombuffer(p["radii"]), np.frombuffer(p["to_parent"])
        vectors = np.frombuffer(p["vectors"], np.int64).reshape(len(radii), p["dim"])
        children = np.frombuffer(p["children"], np.int64)
        if p["leaf"]:
            children = np.arange(seen, seen + len(radii))
            seen += len(radii)
            own = np.frombuffer(p["starts"], np.int64)
            starts.append(own[1:] + starts[-1][-1])
            ids.append(np.frombuffer(p["ids"], np.int64))
            rows.append(np.frombuffer(p["rows"], np.int64))
        pages.append(Page(p["leaf"], vectors, radii, to_parent, children))
    return Tree(pages, largest, np.concatenate(starts), np.concatenate(ids), np.concatenate(rows))


def build(rows: DataFrame, k: int, shard: int = SHARD, max_pivots: int = MAX_PIVOTS, page: int = PAGE) -> Index | None:
    """Index rows (row, id, v, norm) that are written; None if there are none.

    Pivots are the entries with the smallest hashes: a sample of at most ``max_pivots`` vectors; every row is indexed.
    """
    own = materialise(entries(rows, k), "mtree-entries")
    n, largest = own.agg(F.count("*"), F.max("norm")).first()
    if not n:
        return None
    wanted = min(max_pivots, math.ceil(n / shard))
    sample = own.select("v").orderBy(F.xxhash64("v", F.lit(7)), "v").limit(wanted).collect()
    dim = max(len(r["v"]) for r in sample)
    pivots = np.zeros((len(sample), dim), np.int64)
    for i, r in enumerate(sample):
        pivots[i, : len(r["v"])] = r["v"]

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = _to_pivots(matrix(batch.column("v")), pivots, largest, largest)
                region = away.argmin(axis=1)
                extra = [pa.array(region, pa.int32()), pa.array(away[np.arange(len(away)), region])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "region", "away"])

    ship_package(rows.sparkSession)
    placed = own.select("v", "ids", "rows", F.get("rows", F.lit(0)).alias("first_row"))
    placed = materialise(placed.mapInArrow(nearest, "v array<long>, ids array<long>, rows array<long>, first_row long, region int, away double"), "mtree-placed")
    regions = placed.groupBy("region").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"), F.max("away").alias("radius"))
    regions = materialise(regions, "mtree-regions")  # a row for each pivot
    dealt = placed.join(F.broadcast(regions.select("region", "shards")), "region").withColumn("shard", F.pmod(F.xxhash64("first_row"), F.col("shards")).cast("int"))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        return _shard(key[0].as_py(), key[1].as_py(), table, largest, page)

    pages = materialise(dealt.select("region", "shard", "v", "ids", "rows", "first_row").groupBy("region", "shard").applyInArrow(one, PAGES), "mtree-pages")
    radii = np.full(len(pivots), -1.0)
    for r in regions.collect():
        radii[r["region"]] = r["radius"]
    return Index(pages, regions, pivots, radii, largest)


def _to_pivots(vectors: np.ndarray, pivots: np.ndarray, largest: float, lift: float | None) -> np.ndarray:
    """Distances of vectors to lifted pivots; ``lift`` None leaves the vectors' further component 0, as of queries."""
    dim = max(vectors.shape[1], pivots.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (vectors, pivots))
    a = np.pad(a.astype(np.float64), ((0, 0), (0, 1))) if lift is None else _lifted(a, lift)
    return _distances(a, _lifted(b, largest))


def route(queries: DataFrame, index: Index, again: bool) -> DataFrame:
    """(row, id, v, least, region): the region nearest to each query, or, ``again``, every other one that its ``least``
    score (null: none yet) leaves open."""
    pivots, radii, largest = index.pivots, index.radii, index.largest

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                vectors = matrix(piece.column("v"))
                away = _to_pivots(vectors, pivots, largest, None)
                lowest = np.where(radii < 0, np.inf, np.maximum(0, away - radii))
                home = np.lexsort((away, lowest), axis=1)[:, 0]
                if again:
                    square = (vectors.astype(np.float64) ** 2).sum(axis=1)
                    least = piece.column("least").to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
                    slack = 1e-6 * (1 + np.sqrt(square) + math.sqrt(largest))
                    reach = np.where(np.isnan(least), np.finfo(np.float64).max, np.sqrt(np.maximum(0, square + largest - 2 * np.nan_to_num(least))) + slack)
                    open_ = lowest <= reach[:, None]
                    open_[np.arange(len(home)), home] = False
                    who, where = np.nonzero(open_)
                else:
                    who, where = np.arange(len(home)), home
                taken = piece.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(where, pa.int32())], names=[*piece.schema.names, "region"])

    return queries.select("row", "id", "v", "least").mapInArrow(run, "row long, id long, v array<long>, least long, region int")


def visit(routed: DataFrame, index: Index, k: int, block: int = BLOCK) -> DataFrame:
    """(qrow, query_id, vec_id, vrow, score): up to k rows for each query and shard of its region."""
    largest = index.largest
    routed = materialise(routed, "mtree-routed")
    blocks = materialise(routed.groupBy("region").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "mtree-blocks")
    plan = F.broadcast(index.regions.select("region", "shards").join(blocks, "region"))  # a row for each pivot at most

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    asked = routed.join(plan, "region").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    asked = asked.select("row", "id", "v", "least", "region", "block", every(F.col("shards")).alias("shard"))
    pages = index.pages.join(F.broadcast(blocks), "region").select(*index.pages.columns, every(F.col("blocks")).alias("block"))

    def search(own: pa.Table, queries: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        if own.num_rows and queries.num_rows:
            tree = tree_of(own, largest)
            dim = own.column("dim")[0].as_py()
            vectors = matrix(queries.column("v"), dim)[:, :dim]  # what lies behind meets zeros
            for query, row, who, least in zip(vectors, *(queries.column(c).to_pylist() for c in ("row", "id", "least")), strict=True):
                scores, ids, found = tree.search(query, k, row, least)
                for out, values in zip(columns, (np.full(len(scores), row), np.full(len(scores), who), ids, found, scores), strict=True):
                    out.append(values)
        made = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns]
        return pa.Table.from_arrays(made, names=["qrow", "query_id", "vec_id", "vrow", "score"])

    keys = ["region", "shard", "block"]
    return pages.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id", "vrow")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, shard: int = SHARD, max_pivots: int = MAX_PIVOTS, block: int = BLOCK, page: int = PAGE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of each row whose id is divisible by ``every`` with all other rows."""
    session = table.sparkSession
    with scratch(session) as own:
        rows = materialise(quantised(table, id_col, vec_col, scale), "mtree-rows")
        index = build(rows, k, shard, max_pivots, page)
        if index is None:
            return session.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        queries = rows.where(F.col("id") % every == 0)
        first = materialise(_best(visit(route(queries.withColumn("least", F.lit(None).cast("long")), index, False), index, k, block), k).drop("rank"), "mtree-first")
        least = first.groupBy("qrow").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        waiting = queries.join(least, F.col("row") == F.col("qrow"), "left")
        rest = materialise(visit(route(waiting, index, True), index, k, block), "mtree-rest")
        own.keep(first, rest)
    shown = F.when(F.col("vec_id") < _LAST, F.col("vec_id")).alias("vec_id")
    return _best(first.unionByName(rest), k).select("query_id", "rank", shown, "score")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score, b.r AS br FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0),
t AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, br) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20"""
