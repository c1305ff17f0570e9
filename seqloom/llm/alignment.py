"""Cross-tokenizer alignment: the smallest groups of tokens of two tokenizers that cover the same bytes.

Tokens of the two sides that share a byte are linked.  Union-find over that bipartite graph gives its connected
components, which are exactly the minimal groups: two neighbouring tokens of one side are in one component if and only if
a token of the other side covers their border.  The components' members are expanded into links, a document's links
into its distinct id pairs, and those are counted over the corpus (each pair once a document) by a partial aggregate;
the counts then come back to the documents' links, by a broadcast if the counted table is small, else by a shuffle join
whose hot pairs (at most HOT) alone are broadcast.

Both tokenizers begin anew at some borders, whatever stands on their far side: before a space or a line feed that
follows another sign, and behind a single line feed before one.  So a text is cut there into *units*, mostly words with
their space, and only units that a worker has not met before are encoded and aligned; a text is the sequence of its units'
results.  Whether that holds is read off the two vocabularies; if not, whole texts are the units.

Defined results for odd input: null and empty texts, and those whose tokens' bytes differ from a space and the text
on either side, have no tokens: zeros and an empty digest; they count in no pair.  Texts of any length are aligned whole.
Equal and null document ids stay separate rows, each a document of its own; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.batches import map_texts
from seqloom.llm.bpe import _byte_signs
from seqloom.llm.simhash import _hot, _join_hot
from seqloom.plans.durable import materialise, scratch
from seqloom.plans.ship import ship_file, shipped

#: Characters that are handled together, and those of all units that a worker remembers before it starts over.
SLICE = 2 << 20
REMEMBERED = 4 << 20
#: Up to so many id pairs (some 100 bytes each in memory) are broadcast.
MAX_BROADCAST_PAIRS = 600_000
#: Fixed value: Unicode's white space, as in a character class.
_WHITE = r" \t-\r\x85\xa0  -     　"
_OTHER_WHITE = _WHITE.removeprefix(" ").replace(r"\t-\r", r"\t\x0b-\r")
#: A lone line feed; a word with the white space before it, if that begins with a space or a line feed; white space at the end.
UNIT = re.compile(rf"\n(?=[^{_WHITE}])|(?:[ \n][{_WHITE}]*)?[^{_WHITE}]+(?:[{_OTHER_WHITE}][{_WHITE}]*[^{_WHITE}]*)*|[{_WHITE}]+")
_BORDER = re.compile(rf"[^{_WHITE}](?= )")


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the overlapping tokens of A and B, given where each token ends: between two neighbouring ends of either
    side lies one token of each, and every overlap has one such stretch that ends first."""
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, by union-find over all links (a, b) at once: roots are hooked under the
    smallest root that they are linked to, then paths are halved until every node points to its root."""
    parent = np.arange(n)
    while True:
        one, other = parent[a], parent[b]
        apart = one != other
        if not apart.any():
            return parent
        one, other = one[apart], other[apart]
        np.minimum.at(parent, np.maximum(one, other), np.minimum(one, other))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


class ByteSide:
    """A byte-level BPE of the tokenizers library; special tokens' strings are plain text."""

    def __init__(self, path: str) -> None:
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.tokenizer = tokenizers.Tokenizer.from_str(json.dumps(said | {"truncation": None, "padding": None}))
        self.tokenizer.encode_special_tokens = True
        byte_of = {sign: i for i, sign in enumerate(_byte_signs())}
        self.bytes_of = [b""] * (1 + max(said["model"]["vocab"].values()))
        for token, i in said["model"]["vocab"].items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        split = said.get("pre_tokenizer") or {}
        #: Whether words are told apart by the pattern of byte-level vocabularies, which never looks back over a border.
        self.by_unit = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not said.get("normalizer")

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


class PieceSide:
    """A sentencepiece model; it puts a space before a text, which ``encode`` expects to be there already."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of, crossing = [], re.compile(r"[^ \n][ \n]|.\n|\n.", re.DOTALL)
        crosses = False
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            else:
                text = piece.replace("▁", " ")
                self.bytes_of.append(text.encode())
                crosses |= bool(crossing.search(text))
        #: A line feed is a piece of its own: what follows one is encoded as it would be anywhere behind a border.
        self.begin = self.model.encode("\n")
        self.by_unit = not crosses and len(self.begin) == 2 and self.model.encode("\nx\n  x") == [*self.begin, *self.model.encode("\nx")[2:], self.begin[1], *self.model.encode(" x")]

    def encode(self, units: list[str]) -> list[list[int]]:
        skip = len(self.begin)
        out = self.model.encode(["\n" + u for u in units], num_threads=1)
        if any(ids[:skip] != self.begin for ids in out):
            raise ValueError("a line feed is no piece of its own")
        return [ids[skip:] for ids in out]

    def encode_whole(self, text: str) -> list[int]:
        return self.model.encode(text[1:], num_threads=1)


class Aligner:
    """Aligns texts; remembers the units that it has met."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteSide(a_path), PieceSide(b_path)
        self.by_unit = self.a.by_unit and self.b.by_unit
        self.sizes = [np.array([len(x) for x in side.bytes_of]) for side in (self.a, self.b)]
        self.names = [str(i) for i in range(max(map(len, self.sizes)))]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.size = 0
        #: Numbers of the id pairs, each as a << 32 | b.
        self.pair_at: dict[int, int] = {}
        self.pairs = np.zeros(0, np.int64)
        self.groups: list[str] = []
        #: For each unit: tokens of A and B, groups, and 1 if its bytes aren't those of its tokens.
        self.numbers = np.zeros((0, 4), np.int64)
        self.flat, self.first, self.count = (np.zeros(0, np.int64) for _ in range(3))

    def _fits(self, raw: list[bytes], ids: tuple[list[list[int]], list[list[int]]]) -> np.ndarray:
        """Which units have the bytes of their tokens on both sides."""
        joined, out = b"".join(raw), np.ones(len(raw), bool)
        for side, own in zip((self.a, self.b), ids, strict=True):
            said = [b"".join(map(side.bytes_of.__getitem__, x)) for x in own]
            if list(map(len, said)) != list(map(len, raw)) or b"".join(said) != joined:
                out &= np.array([x == y for x, y in zip(said, raw, strict=True)])
        return out

    def _learn(self, units: list[str]) -> None:
        raw = [u.encode() for u in units]
        ids = self.a.encode(units), self.b.encode(units) if self.by_unit else [self.b.encode_whole(u) for u in units]
        good = self._fits(raw, ids)
        ids = tuple([x if ok else [] for x, ok in zip(own, good.tolist(), strict=True)] for own in ids)
        counts = [np.array([len(x) for x in own], np.int64) for own in ids]
        flat = [np.fromiter(chain.from_iterable(own), np.int64, int(n.sum())) for own, n in zip(ids, counts, strict=True)]
        i, j = links_of(*(np.cumsum(size[x]) for size, x in zip(self.sizes, flat, strict=True)))
        n, owner = len(flat[0]), np.repeat(np.arange(len(units)), counts[0])
        root = components(i, n + j, n + len(flat[1]))  # the group's first token of A
        order = np.argsort(root, kind="stable")  # by group, A before B
        group = root[order]
        unit = owner[group]
        groups = np.bincount(owner[np.unique(root)], minlength=len(units))
        # what follows a token: one of its own side, of the other side, a group, a unit
        same = group[1:] == group[:-1]
        crossing = same & (order[1:] >= n) & (order[:-1] < n)
        follows = np.where(crossing, "|", np.where(same, ",", np.where(unit[1:] == unit[:-1], ";", "\n"))).tolist()
        said = [""] * (2 * len(order))
        said[::2] = map(self.names.__getitem__, np.concatenate(flat)[order].tolist())
        said[1:-1:2] = follows
        shown = iter("".join(said).split("\n"))
        self.index.update(zip(units, range(len(self.groups), len(self.groups) + len(units)), strict=True))
        self.size += sum(map(len, units))
        self.groups += [next(shown) if ok else "" for ok in good.tolist()]
        self.numbers = np.concatenate([self.numbers, np.stack([*counts, groups, ~good], axis=1).astype(np.int64)])
        distinct, number = np.unique(flat[0][i] << 32 | flat[1][j], return_inverse=True)
        known = self.pair_at
        numbers = np.fromiter((known.setdefault(p, len(known)) for p in distinct.tolist()), np.int64, len(distinct))
        links = np.bincount(owner[i], minlength=len(units))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(links) - links])
        self.count = np.concatenate([self.count, links])
        self.flat = np.concatenate([self.flat, numbers[number]])
        if len(known) > len(self.pairs):
            self.pairs = np.fromiter(known, np.int64, len(known))

    def _parts(self, texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
        """(number of its text, part) of all texts, in lists of about SLICE characters; parts end at borders."""
        held, size = [], 0
        for at, text in enumerate(texts):
            if not text:
                continue
            text, start = " " + text, 0
            while start < len(text):
                border = _BORDER.search(text, start + SLICE) if self.by_unit else None
                end = border.end() if border else len(text)
                held.append((at, text[start:end]))
                size, start = size + end - start, end
                if size >= SLICE:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text (tokens of A and B, groups), the digest of its groups, and of all (text, pair, times) sorted by text."""
        if self.size > REMEMBERED:
            self.forget()
        sums, digests = np.zeros((len(texts), 4), np.int64), {}
        used: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for parts in self._parts(texts):
            units = [UNIT.findall(part) if self.by_unit else [part] for _, part in parts]
            new = [u for u in set().union(*units) if u not in self.index]
            if new:
                self._learn(new)
            rows = [np.fromiter(map(self.index.__getitem__, u), np.int64, len(u)) for u in units]
            owner = np.repeat([at for at, _ in parts], [len(r) for r in rows])
            for (at, _), own in zip(parts, rows, strict=True):
                said = ";".join(map(self.groups.__getitem__, own.tolist())).encode()
                if at in digests:
                    digests[at].update(b";")
                    digests[at].update(said)
                else:
                    digests[at] = hashlib.sha256(said)
            keys, times = np.unique(owner * len(self.groups) + np.concatenate(rows), return_counts=True)
            at, unit = np.divmod(keys, len(self.groups))
            np.add.at(sums, at, self.numbers[unit] * times[:, None])
            counts = self.count[unit]
            inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            used.append((np.repeat(at, counts), self.flat[np.repeat(self.first[unit], counts) + inside], np.repeat(times, counts)))
        n = max(1, len(self.pair_at))
        at, pair, times = (np.concatenate([u[i] for u in used]) if used else np.zeros(0, np.int64) for i in range(3))
        good = sums[at, 3] == 0
        keys, where = np.unique((at * n + pair)[good], return_inverse=True)
        total = np.bincount(where, weights=times[good], minlength=len(keys)).astype(np.int64)
        bad = sums[:, 3] > 0
        sums[bad] = 0
        shown = [digests[i].hexdigest() if i in digests and not bad[i] else "" for i in range(len(texts))]
        return sums[:, :3], shown, (keys // n, keys % n, total)


_LOADED: dict[tuple[str, str], Aligner] = {}


def load(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


def _forget() -> None:
    for own in _LOADED.values():
        own.forget()


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_sl_row, id, n_a, n_b, n_groups, groups_sha256, pairs): pairs are the distinct linked ids (a, b) with the number of
    their links in this document.  ``_sl_row`` tells rows apart once this is written; both files are shipped."""
    session, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    a_file, b_file = ship_file(session, a_path), ship_file(session, b_path)

    def setup() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own = load(shipped(a_file), shipped(b_file))

        def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
            sums, digests, (at, pair, times) = own.align(piece.column(2).to_pylist())
            ends = np.searchsorted(at, np.arange(piece.num_rows + 1))
            ids = own.pairs[pair]
            links = pa.StructArray.from_arrays([pa.array(ids >> 32), pa.array(ids & 0xFFFFFFFF), pa.array(times)], names=["a", "b", "n"])
            columns = [pa.array(sums[:, i]) for i in range(3)]
            return pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), *columns, pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), links)],
                names=["_sl_row", id_col, "n_a", "n_b", "n_groups", "groups_sha256", "pairs"],
            )

        return apply

    rows = docs.select(F.monotonically_increasing_id().alias("_sl_row"), id_col, text_col)
    schema = f"_sl_row long, `{id_col}` {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<struct<a: long, b: long, n: long>>"
    return map_texts(rows, ["_sl_row", id_col, text_col], None, schema, setup=setup, after=_forget)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, docs, best) from (row, a, b), a row for each pair of a document; best: no b has more documents with this a.

    An a has at most as many rows as B's vocabulary has ids.
    """
    counted = materialise(links.groupBy("a", "b").agg(F.count("*").alias("docs")), "align-counts")
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))
    return counted.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, pairs) of each row of ``docs``.

    n_best counts links whose pair's documents are the most that its a has with any b; count_sum adds all links' documents.
    """
    bound = MAX_BROADCAST_PAIRS if max_broadcast is None else max_broadcast
    with scratch(docs.sparkSession) as own:
        found = materialise(aligned(docs, a_path, b_path, id_col, text_col), "align-docs")
        links = found.select("_sl_row", F.inline("pairs"))
        counts = materialise(pair_counts(links), "align-pairs")
        if counts.count() <= bound:
            met = links.join(F.broadcast(counts), ["a", "b"])
        else:
            total = counts.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
            met = _join_hot(links, counts, counts.where(F.col("docs") >= _hot(total)).select("a", "b"), ["a", "b"])
        sums = met.groupBy("_sl_row").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
        sums = materialise(sums, "align-sums")
        own.keep(found, sums)
    totals = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return found.join(sums, "_sl_row", "left").select(id_col, "n_a", "n_b", "n_groups", *totals, "groups_sha256", "pairs")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).drop("pairs")
