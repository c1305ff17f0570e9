"""BPE encoding and decoding by prefix-sharing traversal of a trie of words.

The last token of a prefix's encoding determines the rest: the encoding of a prefix that ends in token t is the
encoding of the prefix before t, then t.  So a word's encoding is known from one *last token* for each of its prefixes,
and words with a common beginning share them.  Distinct words are inserted into a trie; a depth-first walk carries
the last tokens of the path and computes each node's once: the one vocabulary entry that ends the node's prefix and
may stand after the last token before it.  Two tokens may stand side by side if no merge crosses their border at any
time while both are being built, which is read off the merge ranks along their inner edges.

Plain Latin-1 texts, a batch at a time, are split into words by ``words.WordTable``, which hands over each distinct word
once; other texts are split piece by piece.  Around it stands what the vocabulary's file asks for: special tokens are cut out of the raw text, text is composed
(NFC), lower-cased letter by letter and split into letters, digits and other signs; the last byte of a word carries
the end mark.

Defined results for odd input: null and empty texts have no tokens and decode to the empty string; null or unknown ids
decode to nothing; whole texts are encoded, whatever their length; equal and null document ids stay separate rows;
empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.batches import map_texts
from seqloom.llm.words import WordTable
from seqloom.plans.ship import ship_file, shipped

#: Pieces that a worker remembers before it starts over, and pairs of tokens.
REMEMBERED = 50_000
REMEMBERED_PAIRS = 150_000
#: Bytes of text that are split together.
SLICE = 1 << 18
#: Words of a trie; sorted, so that most that share a beginning are in one.
TRIE_WORDS = 4_096
#: Fixed value: how the vocabulary's file splits text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed value: Unicode's white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: From here on the library splits.
LATIN_END = "\u0250"
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def _byte_signs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies: itself if printable, else from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


_PIECE = regex.compile(f"[^{_WHITE}]+")


def split_pieces(text: str) -> list[str]:
    """White-space-delimited pieces; str.split() also splits at four separators that aren't white space in Unicode."""
    return _PIECE.findall(text) if _ODD_SPACE.search(text) else text.split()


def read_spec(path: str) -> dict:
    """A tokenizer file, if it is of the supported form."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or split != WORD_PATTERN:
        raise ValueError("not a word-end BPE file of the supported form")
    return spec


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        spec = read_spec(path)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        signs = _byte_signs()
        byte_of = {s: b for b, s in enumerate(signs)}
        self.byte_of_sign = {s: chr(b) for s, b in byte_of.items()}
        self.path = path
        self.word = regex.compile(WORD_PATTERN.replace(r"\s", _WHITE))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special)))

        def symbols(token: str) -> str:
            """One character for each byte, 256 higher for the last byte of a word."""
            body = token.removesuffix(self.end)
            codes = [byte_of[c] for c in body]
            if len(body) < len(token):
                codes[-1] += 256
            return "".join(map(chr, codes))

        n = 1 + max(model["vocab"].values())
        if n > 1 << 16:
            raise ValueError("ids above 65535, or a symbol that is no token")
        self.size = array("H", bytes(2 * n))
        self.by_symbols: dict[str, int] = {}
        for token, i in model["vocab"].items():
            if token not in self.special:
                s = symbols(token)
                self.by_symbols[s] = i
                self.size[i] = len(s)
        #: By both tokens in one number: the rank of their merge.  By token: what it is made of, and the rank, -1 if it isn't.
        self.merge: dict[int, int] = {}
        self.parts = array("H", bytes(2 * n)), array("H", bytes(2 * n))
        self.rank = array("i", [-1]) * n
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if self.rank[made] >= 0:
                raise ValueError("a token is made by more than one merge")
            self.merge[i << 16 | j] = rank
            self.parts[0][made], self.parts[1][made], self.rank[made] = i, j, rank
        self._pairs: dict[int, bool] = {}
        if any(chr(i) not in self.by_symbols for i in range(512)):
            raise ValueError("ids above 65535, or a symbol that is no token")
        #: Tokens in order, which tells beginnings of tokens, and the states of the walk that were met so far.
        self.sorted = sorted(self.by_symbols)
        self._states: dict[str, dict] = {"": {"": "", 0: ()}}
        self._check_vocabulary()
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self.table = WordTable(self._encode_new)

    @cached_property
    def library(self) -> tokenizers.Tokenizer:
        """The library's own tokenizer, for texts in other scripts; loaded if one occurs."""
        return tokenizers.Tokenizer.from_file(self.path)

    # ---- which tokens may stand side by side

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that lie at one edge of ``token`` while it is built (side 0 left, 1 right), each with the rank of the merge that takes it in."""
        parts, rank, taken = self.parts[side], self.rank, float("inf")
        known = [(token, taken)]
        while (taken := rank[token]) >= 0:
            token = parts[token]
            known.append((token, taken))
        return known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between a and b alone."""
        known = self._pairs.get(a << 16 | b)
        if known is None:
            known, edge = True, self._edge(b, 0)
            for x, gone_x in self._edge(a, 1):
                for y, gone_y in edge:
                    rank = self.merge.get(x << 16 | y)
                    # equal merges go from left to right: inside a before the border, inside b after it
                    if rank is not None and rank < gone_x and rank <= gone_y:
                        known = False
            if len(self._pairs) >= REMEMBERED_PAIRS:
                self._pairs.clear()
            self._pairs[a << 16 | b] = known
        return known

    # ---- the trie

    def _check_vocabulary(self) -> None:
        """Every token's own text must be encoded as that token, or the walk could choose one that BPE never makes."""
        for pair, rank in self.merge.items():
            edge = self._edge(pair & 0xFFFF, 0)
            for x, gone_x in self._edge(pair >> 16, 1):
                for y, gone_y in edge:
                    r = self.merge.get(x << 16 | y)
                    if r is not None and r < rank and r < gone_x and r <= gone_y:
                        raise ValueError("a token that its own text does not give")

    def _begins(self, end: str) -> bool:
        """Whether some token begins like this."""
        at = bisect_left(self.sorted, end)
        return at < len(self.sorted) and self.sorted[at].startswith(end)

    def _advance(self, state: dict, sign: str) -> dict:
        """The state after one more symbol: it stands for the longest end of the path that begins some token.

        A state is a dictionary of known next states by symbol; under "" is that end, under 0 are the tokens that end
        here, longest first, as (token, size).
        """
        end = state[""] + sign
        while not self._begins(end):
            end = end[1:]
        known = self._states.get(end)
        if known is None:
            ends = (self.by_symbols.get(end[i:]) for i in range(len(end)))
            known = self._states[end] = {"": end, 0: tuple((t, self.size[t]) for t in ends if t is not None)}
        state[sign] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of distinct words, each given as symbols: one character for each byte, 256 higher for the last."""
        every, found = sorted(words), {}
        for at in range(0, len(every), TRIE_WORDS):
            self._walk(every[at : at + TRIE_WORDS], found)
        return found

    def _walk(self, words: list[str], found: dict[str, list[int]]) -> None:
        """The ids of the words of one trie, added to ``found``."""
        trie: dict = {}
        for w in words:
            node = trie
            for c in w[:-1]:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            node[w[-1]] = w  # only last symbols are above 255, so a word never goes on below its end
        last: list[int] = []  # last[n - 1]: last token of the first n symbols of the path
        pairs, size_of, may_follow = self._pairs, self.size, self.may_follow
        stack: list[tuple[int, dict, dict]] = [(0, self._states[""], trie)]
        while stack:
            depth, state, node = stack.pop()
            if depth:
                del last[depth - 1 :]
                for token, size in state[0]:
                    if size == depth:
                        break
                    fits = pairs.get(last[-size] << 16 | token)
                    if fits if fits is not None else may_follow(last[-size], token):
                        break
                last.append(token)
            depth += 1
            for c, below in node.items():
                after = state.get(c) or self._advance(state, c)
                if type(below) is dict:
                    stack.append((depth, after, below))
                    continue
                for token, size in after[0]:
                    if size == depth:
                        break
                    fits = pairs.get(last[-size] << 16 | token)
                    if fits if fits is not None else may_follow(last[-size], token):
                        break
                ids, n = [token], depth - size
                while n:
                    token = last[n - 1]
                    ids.append(token)
                    n -= size_of[token]
                ids.reverse()
                found[below] = ids

    # ---- texts

    def _pretokens(self, piece: str) -> list[str]:
        """Words of a piece of text, as symbols.

        Latin text is split here; for other scripts the library's normaliser and splitter are asked, so that a letter
        that only newer versions of Unicode know is treated as the library treats it.
        """
        if piece.isascii():
            words = [piece.lower()] if piece.isalpha() else self.word.findall(piece.lower())
        elif max(piece) < LATIN_END:
            words = [w.encode().decode("latin-1") for w in self.word.findall(unicodedata.normalize("NFC", piece).lower())]
        else:
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
            words = ["".join([self.byte_of_sign[c] for c in w]) for w, _ in split]
        return [w[:-1] + chr(ord(w[-1]) + 256) for w in words]

    def learn(self, pieces: Iterable[str]) -> None:
        """Make sure that the ids of all pieces are remembered."""
        if len(self._pieces) >= REMEMBERED:
            self._pieces.clear()
        if len(self._words) >= REMEMBERED:
            self._words.clear()
        new = {p: self._pretokens(p) for p in pieces if p not in self._pieces}
        words = {w for ws in new.values() for w in ws if w not in self._words}
        for w, ids in self.encode_words(words).items():
            self._words[w] = np.array(ids, "<u4").tobytes()
        for p, ws in new.items():
            self._pieces[p] = b"".join([self._words[w] for w in ws])

    def _encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        marked = [w.decode("latin-1")[:-1] + chr(w[-1] + 256) for w in words]
        collects = gc.isenabled()
        gc.disable()  # the trie is a tree of many dictionaries without cycles
        try:
            found = self.encode_words(marked)
        finally:
            if collects:
                gc.enable()
        ids = list(map(found.__getitem__, marked))
        return np.array(list(chain.from_iterable(ids)), np.uint32), np.array(list(map(len, ids)), np.int64)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.table.encode_or(texts, self.encode_pieces)

    def encode_pieces(self, texts: list[str | None]) -> list[bytes]:
        """As ``encode_batch``, for texts in any script and with special tokens."""
        cut: list[list[str]] = []
        for text in texts:
            if not text:
                cut.append([])
            elif "<|" in text and self.special_pattern.search(text):
                parts, at = [], 0
                for m in self.special_pattern.finditer(text):
                    parts += [*split_pieces(text[at : m.start()]), "\x00" + m[0]]
                    at = m.end()
                cut.append(parts + split_pieces(text[at:]))
            else:
                cut.append(split_pieces(text))
        distinct = set().union(*cut) if cut else set()
        marks = {s for s in distinct if s.startswith("\x00") and s[1:] in self.special}
        self.learn(distinct - marks)
        known = self._pieces
        if marks:
            known = {**{p: self._pieces[p] for p in distinct - marks}, **{s: np.array([self.special[s[1:]]], "<u4").tobytes() for s in marks}}
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]


def decode_ids(names: dict[int, str], ids: bytes | None) -> str:
    """Token strings joined by spaces, as files without a decoder define it; special tokens are kept."""
    return " ".join([n for n in map(names.get, np.frombuffer(ids or b"", "<u4").tolist()) if n is not None])


def load_names(path: str) -> dict[int, str]:
    """Token strings of a tokenizer file by id, once a worker."""
    if path not in _NAMES:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["decoder"] is not None:
            raise ValueError("only files without a decoder are supported")
        _NAMES[path] = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return _NAMES[path]


_NAMES: dict[str, dict[int, str]] = {}
_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The vocabulary of a file, once a worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def forget() -> None:
    """Give the memory of words back at the end of a task; a worker may idle for long, beside others."""
    for own in _LOADED.values():
        own.table.forget()
        own._words.clear()
        own._pieces.clear()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids are little-endian unsigned 32-bit integers.  The file at ``path`` is shipped to the executors."""
    kind, file = docs.schema[id_col].dataType.simpleString(), ship_file(docs.sparkSession, path)

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(load(shipped(file)).encode_batch(piece.column(1).to_pylist()), pa.binary())], names=[id_col, "ids"])

    return map_texts(docs, [id_col, text_col], apply, f"`{id_col}` {kind}, ids binary", limit=SLICE, after=forget)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded)."""
    kind, file = encoded.schema[id_col].dataType.simpleString(), ship_file(encoded.sparkSession, path)

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        names = load_names(shipped(file))
        texts = [decode_ids(names, x) for x in piece.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    return map_texts(encoded, [id_col, ids_col], apply, f"`{id_col}` {kind}, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ``encode`` and ``decode`` in one pass over the texts."""
    kind, file = docs.schema[id_col].dataType.simpleString(), ship_file(docs.sparkSession, path)

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        at = shipped(file)
        ids, names = load(at).encode_batch(piece.column(1).to_pylist()), load_names(at)
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.binary()), pa.array([decode_ids(names, x) for x in ids], pa.string())], names=[id_col, "ids", "decoded"])

    return map_texts(docs, [id_col, text_col], apply, f"`{id_col}` {kind}, ids binary, decoded string", limit=SLICE, after=forget)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded documents."""
    return coded.select(
        id_col, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
