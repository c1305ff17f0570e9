import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_a long, pairs string, a long, docs int, _sl_rows long"
ODD = [None, "", " ", "\n", "\n\n", " \n x", "a\r\nb;\r\n\r\n c", "  two  spaces \t tab nb　x ", "<|endoftext|> <s></s><unk> ▁x", "x▁y", "é ﬁ ① ​ q", "\x1c \x1f\x1fa \x85b", "don't I'LL we've '' 's", "日本語 текст 😀😀 é", "nul\x00 in", "a" * 3000, "aé日" * 700, "end \n", "\r", "x\n\ny\nz \n w"]


class Library:
    """Both libraries on whole texts, and the definitions word for word."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        signs = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        self.bytes_a = lambda i: bytes(signs[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        """(ids of A, ids of B, groups, links) of a text."""
        if not text:
            return [], [], [], []
        a, b, raw = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        if b"".join(map(self.bytes_a, a)) != raw or b"".join(map(self.bytes_b, b)) != raw:
            return [], [], [], []
        spans = []
        for ids, of in ((a, self.bytes_a), (b, self.bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at := at + len(of(i))))
            spans.append(out)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, lo = [], 0
        for hi in cuts:
            groups.append(tuple([i for i, (s, e) in zip(ids, own) if lo <= s and e <= hi] for ids, own in zip((a, b), spans)) if len(raw) < 400 else None)
            lo = hi
        if len(raw) >= 400:  # the same, with one walk
            groups, i, j = [], 0, 0
            for hi in cuts:
                i0, j0 = i, j
                while i < len(a) and spans[0][i][1] <= hi:
                    i += 1
                while j < len(b) and spans[1][j][1] <= hi:
                    j += 1
                groups.append((a[i0:i], b[j0:j]))
        links = []
        j0 = 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and spans[1][j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        return a, b, groups, links


@pytest.fixture(scope="module")
def library():
    return Library()


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def shown(groups):
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return hashlib.sha256(text.encode()).hexdigest() if groups else ""


def check(aligner, library, texts):
    sums, digests, (at, pair, times) = aligner.align(texts)
    got = [Counter() for _ in texts]
    for i, p, n in zip(at.tolist(), pair.tolist(), times.tolist()):
        got[i][divmod(int(aligner.pairs[p]), 1 << 32)] += n
    for i, text in enumerate(texts):
        a, b, groups, links = library.groups(text)
        assert sums[i].tolist() == [len(a), len(b), len(groups)], repr(text)[:200]
        assert digests[i] == shown(groups), repr(text)[:200]
        assert got[i] == Counter(links), repr(text)[:200]


def test_union_find_gives_minimal_groups():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 30)
        ends = [sorted({*rng.sample(range(1, n + 1), rng.randrange(0, n)), n}) for _ in range(2)]
        i, j = alignment.links_of(*map(np.array, ends))
        spans = [list(zip([0, *e], e)) for e in ends]
        assert sorted(zip(i.tolist(), j.tolist())) == sorted((i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        first = len(ends[0])
        root = alignment.components(i, first + j, first + len(ends[1])).tolist()
        assert len(set(root)) == len(cuts)
        for v, r in enumerate(root):
            assert r == min(u for u, q in enumerate(root) if q == r)
            own = [u for u, q in enumerate(root) if q == r]
            assert max(ends[0][u] for u in own if u < first) == max(ends[1][u - first] for u in own if u >= first) == cuts[sorted(set(root)).index(r)]


def test_components_of_any_graph():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 40)
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 40))]
        slow = list(range(n))
        for _ in range(n):
            for a, b in links:
                slow[a] = slow[b] = min(slow[a], slow[b])
        a, b = np.array([x for x, _ in links], int), np.array([x for _, x in links], int)
        assert alignment.components(a, b, n).tolist() == slow


def test_both_vocabularies_are_cut_into_units(aligner):
    assert aligner.by_unit


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab.'s1é日\r\n\t \x0b\x0c\x85  　\x1c;)*{▁<|>")) | st.text(), min_size=1, max_size=8))
def test_units_match_whole_texts(texts):
    check(_own[0], _own[1], [t.encode("utf-8", "ignore").decode() for t in texts])


_own = (alignment.Aligner(A, B), Library())


def test_odd_and_long_texts(aligner, library, monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshrdlucm,.;'é1") for _ in range(rng.randrange(1, 12)))
    texts = ODD + ["".join(word() + rng.choice([" ", " ", " ", "\n", "  ", "\r\n", "\t"]) for _ in range(600)) for _ in range(20)]
    check(aligner, library, texts)
    monkeypatch.setattr(alignment, "SLICE", 300)
    monkeypatch.setattr(alignment, "REMEMBERED", 1)
    check(aligner, library, texts)
    check(aligner, library, [])
    whole = alignment.Aligner(A, B)
    whole.by_unit = False
    check(whole, library, texts)


def saved(spark, tmp_path, texts):
    rows = [(i // 2 if i else None, t, 7, "p", 1, 2, 3) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def expected(library, rows):
    found = [library.groups(t) for _, t, *_ in rows]
    docs = Counter(p for *_, links in found for p in set(links))
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    return sorted(
        repr((r[0], len(a), len(b), len(g), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), shown(g)))
        for r, (a, b, g, links) in zip(rows, found)
    )


@pytest.mark.parametrize("bound", [None, 0])
def test_alignment_query(spark, tmp_path, library, monkeypatch, bound):
    rows = saved(spark, tmp_path, ODD + ["the same words", "the same words", "same word, other words"] * 5)
    if bound is not None:
        monkeypatch.setattr(alignment, "MAX_BROADCAST_PAIRS", bound)
    got = alignment.op12_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(library, rows)


def test_alignment_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert alignment.alignment(none, A, B).count() == 0
    no_tokens = spark.createDataFrame([(1, None, 0, "", 0, 0, 0)], DOCS)
    assert alignment.alignment(no_tokens, A, B).select("n_links", "groups_sha256").first()[:] == (0, "")
