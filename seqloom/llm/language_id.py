"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into runs of ``run`` bytes (the last one padded with spaces).  Two gated recurrent units
read each run forwards and backwards, a softmax over both states labels every byte, and the mean of the bytes'
probabilities is the document's.  Many runs advance together, one byte position a step, so the work of a step is a few
array operations whatever the lengths of the texts; no text is cut short.

Training is plain numpy: backpropagation through time and Adam.  It learns from a bounded sample of documents (``max_docs``
of them, those with the smallest MD5 of their id), cut into runs as in prediction; of a text with more than ``max_runs``
runs the executors draw that many from all over it, so at most max_docs * max_runs * run bytes (6 MB) reach the driver,
more runs than the fit's steps look at.  Each step draws languages alike, then documents of a language alike, then runs of
a document alike, so neither a common language nor a long text crowds out the others, and the fit costs the same at
every scale.  The model holds about two thousand numbers.

Defined results for odd input: a null text or one without a letter is ``und`` with score 0, as is every text if
there is nothing to learn from; null languages and null texts are not learned from; equal and null ids stay separate
rows; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.batches import map_texts
from seqloom.llm.sampling import smallest

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Runs that advance together in a prediction.
LANES = 2048


@dataclass(frozen=True)
class GruModel:
    """``table``: (2, 3H, 256) input terms of the reset, update and candidate rows; ``recur``: (2, 3H, H); ``out``: (K, 2H); ``bias``: (K,)."""

    languages: tuple[str, ...]
    table: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    run: int

    @property
    def hidden(self) -> int:
        return self.recur.shape[2]


def _squash(a: np.ndarray) -> None:
    """Logistic function in place."""
    a *= 0.5
    np.tanh(a, out=a)
    a *= 0.5
    a += 0.5


def _states(m: GruModel, x: np.ndarray) -> np.ndarray:
    """Hidden states (T, 2, H, B) of bytes x (T, B); [t, 1] belongs to position T-1-t."""
    steps, lanes = x.shape
    hid = m.hidden
    rows = np.ascontiguousarray(m.table.transpose(0, 2, 1))
    took, own, past = np.empty((lanes, 3 * hid), np.float32), np.empty((2, 3 * hid, lanes), np.float32), np.empty((2, 3 * hid, lanes), np.float32)
    h, states = np.zeros((2, hid, lanes), np.float32), np.empty((steps, 2, hid, lanes), np.float32)
    for t in range(steps):
        for way, at in ((0, t), (1, steps - 1 - t)):
            np.take(rows[way], x[at], axis=0, out=took, mode="clip")
            own[way] = took.T
        np.matmul(m.recur, h, out=past)
        gates = own[:, : 2 * hid]
        gates += past[:, : 2 * hid]
        _squash(gates)
        new = past[:, 2 * hid :]
        new *= own[:, :hid]
        new += own[:, 2 * hid :]
        np.tanh(new, out=new)
        h -= new
        h *= own[:, hid : 2 * hid]
        h += new
        states[t] = h
    return states


def label_runs(m: GruModel, x: np.ndarray) -> np.ndarray:
    """Probabilities (T, K, B) of every position of bytes x (T, B)."""
    states, hid = _states(m, x), m.hidden
    p = np.matmul(m.out[:, :hid], states[:, 0])
    p += np.matmul(m.out[:, hid:], states[::-1, 1])
    p += m.bias[:, None]
    np.exp(p, out=p)  # logits of at most 2H bounded terms: no overflow guard is needed
    p /= p.sum(axis=1, keepdims=True)
    return p


def _runs(texts: list[bytes], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(N, run) bytes of all texts, the bytes that count in each run, and each text's first run."""
    sizes = np.array([len(t) for t in texts])
    parts = np.maximum(1, -(-sizes // run))
    data = b"".join(t.ljust(int(k) * run) for t, k in zip(texts, parts, strict=True))
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    valid = np.full(int(parts.sum()), run)
    valid[first + parts - 1] = sizes - (parts - 1) * run
    return np.frombuffer(data, np.uint8).reshape(-1, run), valid, first


def pooled(m: GruModel, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (len(texts), K) over all bytes; zeros for empty texts."""
    if not texts:
        return np.zeros((0, len(m.languages)))
    x, valid, first = _runs(texts, m.run)
    sums = np.empty((len(x), len(m.languages)))
    order = np.arange(m.run)[:, None]
    for at in range(0, len(x), LANES):
        lanes = slice(at, at + LANES)
        p = label_runs(m, x[lanes].T.astype(np.intp))
        if (valid[lanes] < m.run).any():
            p *= (order < valid[lanes])[:, None, :]
        sums[lanes] = p.sum(axis=0).T
    return np.add.reduceat(sums, first, axis=0) / np.maximum(1, [len(t) for t in texts])[:, None]


def label_bytes(m: GruModel, text: str) -> list[str]:
    """The language label of every byte of a text."""
    x, valid, _ = _runs([text.encode()], m.run)
    best = label_runs(m, x.T.astype(np.intp)).argmax(axis=1).T
    return [m.languages[k] for row, n in zip(best, valid, strict=True) for k in row[:n]]


# ---- training


def _shapes(hid: int, k: int) -> list[tuple[int, ...]]:
    return [(2, 3 * hid, 256), (2, 3 * hid, hid), (k, 2 * hid), (k,)]


def loss_and_gradient(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over counted positions and its gradient by backpropagation through time.

    x: bytes (T, B); y: class of each lane; counts: 1 where a position counts (T, B).
    """
    table, recur, out, bias = params
    steps, lanes = x.shape
    hid, kind = recur.shape[2], table.dtype
    ends = [np.arange(steps), np.arange(steps)[::-1]]
    h, kept, states = np.zeros((2, hid, lanes), kind), [], np.empty((steps, 2, hid, lanes), kind)
    for t in range(steps):
        own = np.stack([table[w][:, x[ends[w][t]]] for w in (0, 1)])
        past = recur @ h
        gates = own[:, : 2 * hid] + past[:, : 2 * hid]
        _squash(gates)
        r, z = gates[:, :hid], gates[:, hid:]
        new = np.tanh(own[:, 2 * hid :] + r * past[:, 2 * hid :])
        kept.append((h, r, z, new, past[:, 2 * hid :]))
        h = (1 - z) * new + z * h
        states[t] = h
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=1)  # (T, 2H, B)
    logits = out @ both + bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    total = max(1.0, float(counts.sum()))
    lane = np.arange(lanes)
    loss = float(-(np.log(p[:, y, lane] + 1e-12) * counts).sum() / total)
    d = p
    d[:, y, lane] -= 1
    d *= (counts / total)[:, None, :]
    d = d.astype(kind)
    g_out, g_bias = np.einsum("tkb,thb->kh", d, both, optimize=True), d.sum(axis=(0, 2))
    back = out.T @ d
    d_state = np.stack([back[:, :hid], back[::-1, hid:]], axis=1)
    g_table, g_recur, d_h = np.zeros_like(table), np.zeros_like(recur), np.zeros((2, hid, lanes), kind)
    hot = np.zeros((256, lanes), kind)
    for t in range(steps - 1, -1, -1):
        before, r, z, new, cand = kept[t]
        d_h = d_h + d_state[t]
        d_new = d_h * (1 - z) * (1 - new * new)
        d_z = d_h * (before - new) * z * (1 - z)
        d_r = d_new * cand * r * (1 - r)
        d_own = np.concatenate([d_r, d_z, d_new], axis=1)
        d_past = np.concatenate([d_r, d_z, d_new * r], axis=1)
        g_recur += d_past @ before.transpose(0, 2, 1)
        for w in (0, 1):
            seen = x[ends[w][t]]
            hot[seen, lane] = 1
            g_table[w] += d_own[w] @ hot.T
            hot[seen, lane] = 0
        d_h = d_h * z + recur.transpose(0, 2, 1) @ d_past
    return loss, [g_table, g_recur, g_out, g_bias]


def train(texts: list[bytes], labels: list[str], hidden: int = 8, run: int = 64, steps: int = 300, lanes: int = 192, rate: float = 0.02, seed: int = 1) -> GruModel | None:
    """Fit a model to whole labelled texts; None without any."""
    pairs = sorted(((lang, k) for k, lang in enumerate(labels) if texts[k]), key=lambda p: p[0])
    if not pairs:
        return None
    languages = tuple(sorted({lang for lang, _ in pairs}))
    x, valid, first = _runs([texts[k] for _, k in pairs], run)
    y = np.array([languages.index(lang) for lang, _ in pairs])
    parts = np.diff(np.append(first, len(x)))
    docs = np.bincount(y)  # texts of each language, which lie one after the other
    begins = np.cumsum(docs) - docs
    rng = np.random.default_rng(seed)
    params = [(rng.normal(size=s) * (0.3 if len(s) == 3 else 0.2)).astype(np.float32) for s in _shapes(hidden, len(languages))]
    m1s, m2s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        kind = rng.integers(len(languages), size=lanes)
        doc = begins[kind] + (rng.random(lanes) * docs[kind]).astype(np.int64)
        pick = first[doc] + (rng.random(lanes) * parts[doc]).astype(np.int64)
        counts = (np.arange(run)[:, None] < valid[pick]).astype(np.float32)
        _, grads = loss_and_gradient(params, x[pick].T.astype(np.intp), kind, counts)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for p, g, m1, m2 in zip(params, grads, m1s, m2s, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= pace * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return GruModel(languages, *params, run)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drawn_runs(text: str, run: int, max_runs: int) -> bytes:
    """A text's bytes; of one with more than ``max_runs`` runs so many that are drawn from all of it, in their order."""
    raw = text.encode()
    parts = -(-len(raw) // run)
    if parts <= max_runs:
        return raw
    chosen = np.sort(np.random.default_rng(zlib.crc32(raw)).choice(parts, max_runs, replace=False))
    return b"".join(raw[k * run : (k + 1) * run] for k in chosen.tolist())


def training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int, run: int = 64, max_runs: int = 64) -> tuple[list[bytes], list[str]]:
    """Drawn runs and languages of at most ``max_docs`` labelled documents that aren't held out."""
    text, key = F.col("_sl_text"), F.col("_sl_id").cast("string")
    usable = docs.select(F.col(id_col).alias("_sl_id"), F.col(text_col).alias("_sl_text"), F.col(lang_col).alias("_sl_lang")).where(
        F.col("_sl_id").isNotNull() & text.isNotNull() & (text != "") & F.col("_sl_lang").isNotNull() & ~held_out("_sl_id")
    )
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).count()
    kind = docs.schema[lang_col].dataType.simpleString()

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([drawn_runs(t, run, max_runs) for t in piece.column(2).to_pylist()], pa.binary())], names=["_sl_id", "_sl_lang", "_sl_text"])

    def drawn(rows: DataFrame) -> DataFrame:
        keyed = rows.select(key.alias("_sl_id"), "_sl_lang", "_sl_text")
        return map_texts(keyed, ["_sl_id", "_sl_lang", "_sl_text"], apply, f"_sl_id string, _sl_lang {kind}, _sl_text binary")

    rows = smallest(usable, F.md5(key), max_docs, known, ["_sl_id", "_sl_lang", "_sl_text"], drawn)
    return [bytes(row["_sl_text"]) for row in rows], [row["_sl_lang"] for row in rows]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1500, max_runs: int = 64, run: int = 64, **options) -> GruModel | None:
    """The network of the labelled documents that aren't held out; ``max_docs`` and ``max_runs`` bound what it is fitted on."""
    return train(*training_texts(docs, id_col, text_col, lang_col, max_docs, run, max_runs), run=run, **options)


def _predict(own: GruModel | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    known = [i for i, t in enumerate(texts) if own is not None and t and LETTER.search(t)]
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if known:
        probs = pooled(own, [texts[i].encode() for i in known])
        for i, p in zip(known, probs, strict=True):
            langs[i], scores[i] = own.languages[int(p.argmax())], min(1.0, float(p.max()))
    return langs, scores


def identify(docs: DataFrame, model: GruModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; score is the pooled probability of lang_pred."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = _predict(shared.value, piece.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    return map_texts(docs, [id_col, text_col], apply, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: GruModel | None, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language isn't known: no letter, or a score below ``min_score``."""
    columns = [c for c in docs.columns if c != text_col] + [text_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = _predict(shared.value, piece.column(len(columns) - 1).to_pylist())
        return piece.filter(pa.array([lang != UNKNOWN and s >= min_score for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

    return map_texts(docs, columns, apply, docs.select(*columns).schema).select(*docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
