"""Split many Latin-1 texts into the words of a BPE vocabulary at once, and look each distinct word up once.

The texts of a batch are one array of bytes.  Character classes give the words' borders, a 64-bit sum hash groups equal
words (each word is then compared with the first of its group, byte by byte), and only words that this worker has
not met before reach the encoder.  Ids of all texts are gathered from one flat table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words that a worker remembers before it starts over.
REMEMBERED = 250_000

_CHARS = [chr(b) for b in range(256)]
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
#: Class of each Latin-1 character: white space, letter, digit or number sign, other.
_CLASS = np.array(
    [_SPACE if c in "\t\n\x0b\x0c\r \x85\xa0" else _LETTER if c.isalpha() else _DIGIT if c.isnumeric() else _OTHER for c in _CHARS], np.uint8
)
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 256 else ord(c) for c in _CHARS], np.uint8)
_SALT = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_QUOTE = ord("'")


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _contractions(low: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> None:
    """Mark 's 't 'm 'd 're 've 'll as words where the quote begins a run of other signs."""
    at = np.flatnonzero((low == _QUOTE) & starts)
    at = at[at + 3 < len(low)]
    if not len(at):
        return
    a, b = low[at + 1], low[at + 2]
    two = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    three = ~two & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
    starts[at[two | three] + 1] = False
    for mark, size in ((two, 2), (three, 3)):
        end = at[mark] + size
        starts[end] |= kinds[end] != _SPACE


def latin(text: str) -> bytes | None:
    """The text as Latin-1, None if it isn't or may hold a special token."""
    if "<|" in text:
        return None
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


class WordTable:
    """Ids of Latin-1 texts; ``encode_new`` gets distinct lower-case words as UTF-8 and returns their ids in one array, and their numbers of ids."""

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode_new = encode_new
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Give the memory of all words back."""
        self._reset()

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Rows of the table for distinct words, new ones added."""
        if len(self.index) > REMEMBERED:
            self._reset()
        index = self.index
        new = [w for w in words if w not in index]
        if new:
            ids, counts = self.encode_new([w.decode("latin-1").encode() for w in new])
            begin = np.cumsum(counts) - counts + len(self.flat)
            index.update(zip(new, range(len(self.first), len(self.first) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, ids])
            self.first, self.count = np.concatenate([self.first, begin]), np.concatenate([self.count, counts])
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each Latin-1 text as little-endian unsigned 32-bit integers."""
        data = np.frombuffer(b"\n".join([*texts, b"   \n"]), np.uint8)
        low, kinds = _LOWER[data], _CLASS[data]
        starts = np.empty(len(data), bool)
        starts[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
        starts |= kinds == _DIGIT
        gaps = kinds == _SPACE
        ends_too = starts.copy()  # borders, spaces included
        starts &= ~gaps
        before = starts.copy()
        _contractions(low, starts, kinds)
        ends_too |= starts
        ends_too[before & ~starts] = False
        at = np.flatnonzero(starts)
        if not len(at):
            return [b""] * len(texts)
        borders = np.flatnonzero(ends_too)
        ends = borders[np.searchsorted(borders, at) + 1]
        sizes = ends - at
        # position of each byte in its word, for the bytes of words
        n, narrow = int(sizes.sum()), sizes.astype(np.int32)
        inside = np.repeat((at - (np.cumsum(sizes) - sizes)).astype(np.int32), narrow) + np.arange(n, dtype=np.int32)
        place = inside - np.repeat(at.astype(np.int32), narrow)
        body = low[inside]
        cuts = np.cumsum(sizes) - sizes
        weighed = _SALT[body]
        weighed *= _powers(int(sizes.max()))[place]
        sums = np.add.reduceat(weighed, cuts)
        del weighed
        _, heads, group = np.unique(sums, return_index=True, return_inverse=True)
        model = heads[group]
        if not ((sizes == sizes[model]).all() and (body == body[np.repeat(cuts[model].astype(np.int32), narrow) + place]).all()):
            group = self._group_exactly(body, cuts, sizes)
            heads = np.unique(group, return_index=True)[1]
        joined = body.tobytes()
        words = [joined[a:b] for a, b in zip(cuts[heads].tolist(), (cuts[heads] + sizes[heads]).tolist(), strict=True)]
        rows = self._numbers(words)[group]
        counts = self.count[rows]
        upto = np.cumsum(counts)
        ids = self.flat[np.repeat((self.first[rows] - (upto - counts)).astype(np.int32), counts) + np.arange(int(upto[-1]), dtype=np.int32)].astype("<u4")
        lengths = np.array([len(t) + 1 for t in texts])
        borders = np.concatenate([[0], upto])[np.searchsorted(at, np.concatenate([[0], np.cumsum(lengths)]))]
        raw = ids.tobytes()
        cut = (borders * 4).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def encode_or(self, texts: list[str | None], other: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of any texts: ``other`` encodes those that aren't plain Latin-1."""
        plain = [latin(t or "") for t in texts]
        rest = [i for i, t in enumerate(plain) if t is None]
        out = self.encode([t for t in plain if t is not None])
        if rest:
            mixed, more = iter(out), dict(zip(rest, other([texts[i] for i in rest]), strict=True))
            out = [more[i] if i in more else next(mixed) for i in range(len(texts))]
        return out

    @staticmethod
    def _group_exactly(body: np.ndarray, cuts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For the case that two words share a hash."""
        joined, known = body.tobytes(), {}
        return np.array([known.setdefault(joined[a : a + n], len(known)) for a, n in zip(cuts.tolist(), sizes.tolist(), strict=True)])
