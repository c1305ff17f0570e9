"""Memory of a worker that encodes: the vocabulary, and what a slice of texts takes besides."""

import random
import tracemalloc

import public_tokenizers
from tokenizers import Tokenizer

from seqloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def _words(n: int) -> list[str]:
    rng = random.Random(5)
    return ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxzé'", k=rng.randint(2, 12))) for _ in range(n)]


def test_memory_of_vocabulary_and_slice():
    words = _words(bpe.SLICE // 7)  # a slice of words that are all new
    tracemalloc.start()
    own = bpe.WordBpe(PATH)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    own.encode_batch([" ".join(words)])
    peak = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert held < 24 << 20 and peak < 64 << 20, (held >> 20, peak >> 20)


def test_more_words_than_a_trie_holds(monkeypatch):
    monkeypatch.setattr(bpe, "TRIE_WORDS", 7)
    texts = [" ".join(_words(300)), "a", "", "a ab abc abcd abcde abcdef abcdefg abcdefgh abcdefghi"]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    got = bpe.WordBpe(PATH).encode_batch(texts)
    assert [[int.from_bytes(g[i : i + 4], "little") for i in range(0, len(g), 4)] for g in got] == want
