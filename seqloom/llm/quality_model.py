"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are words and pairs of neighbours, hashed into 2**bits weights; a pair of equal words shares one feature
whatever the word.  A text is the sparse vector count / sqrt(number of features), its score the logistic of a sparse
dot product.  Training walks a bounded sample of labelled documents (``max_rows`` of them, those with the smallest
MD5 of their id, whichever the size of the table).  Their whole texts, however long, become sparse vectors on the
executors; the driver gets those, at most 2**bits indices and counts each, so the fit costs the same at every scale
and the model, one float per weight, is a bounded broadcast.

Defined results for odd input: null and empty texts are scored by the bias; labels with null id or quality, or without
a document, are not learned from; of several labels for an id the mean counts (a tie learns 1); without any
label the score is 0.5; equal and null ids stay separate rows; empty tables give empty results; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.batches import map_texts
from seqloom.llm.sampling import smallest

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Distinct tokens whose hashes a task remembers before it starts over.
REMEMBERED = 400_000


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[token] = zlib.crc32(token.encode())
        return value


def features(text: str | None, bits: int, hashes: _Hashes) -> np.ndarray:
    """Indices of a text's n-grams, repeats included."""
    tokens = TOKEN.findall(text or "")
    one = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint32, count=len(tokens))
    pair = one[:-1] * np.uint32(0x9E3779B1) ^ (one[1:] * np.uint32(0x85EBCA6B) + np.uint32(0x165667B1))
    pair[one[:-1] == one[1:]] = 0xA5A5A5A5
    return np.concatenate([one, pair]) >> np.uint32(32 - bits)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, text: str | None, hashes: _Hashes) -> float:
        index = features(text, self.bits, hashes)
        dot = float(self.weights[index].sum(dtype=np.float64)) / np.sqrt(len(index)) if len(index) else 0.0
        return 1.0 / (1.0 + float(np.exp(-np.clip(dot + self.bias, -30, 30))))


def vector(text: str | None, bits: int, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(indices, counts) of a text's distinct features."""
    index, count = np.unique(features(text, bits, hashes), return_counts=True)
    return index.astype(np.uint32), count.astype(np.uint32)


def fit_vectors(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], bits: int = 18, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3, seed: int = 1) -> QualityModel:
    """Follow-the-regularised-leader (proximal) over the examples, one update per text."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    seen = [(np.append(index.astype(np.int64), size), np.append(count / np.sqrt(max(1, count.sum(dtype=np.int64))), 1.0)) for index, count in vectors]
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, shrunk / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(seen)):
            at, x = seen[k]
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[k]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]), bits)


def fit_ftrl(texts: list[str | None], labels: list[int], bits: int = 18, **options) -> QualityModel:
    """As ``fit_vectors``, from texts."""
    hashes = _Hashes()
    return fit_vectors([vector(t, bits, hashes) for t in texts], labels, bits, **options)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, bits: int) -> tuple[list, list]:
    """Vectors and labels of at most ``max_rows`` labelled ids that aren't held out, by MD5 of the id: a sample of fixed bound.

    Of rows with one id the smallest text is learned from.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_sl_id"), F.col(label_col).cast("double").alias("_sl_y"))
    mean = usable.groupBy("_sl_id").agg((F.avg("_sl_y") >= 0.5).cast("int").alias("_sl_y"))
    chosen = smallest(mean, F.md5(F.col("_sl_id").cast("string")), max_rows, usable.count(), ["_sl_id"])
    table = docs.sparkSession.createDataFrame(chosen, mean.schema)
    texts = docs.select(F.col(id_col).alias("_sl_doc"), F.col(text_col).alias("_sl_text"))
    joined = texts.join(F.broadcast(table), F.col("_sl_doc") == F.col("_sl_id"))  # at most max_rows rows
    single = joined.groupBy("_sl_doc", "_sl_y").agg(F.min("_sl_text").alias("_sl_text"))
    names, kind = ["_sl_doc", "_sl_y", "_sl_index", "_sl_count"], docs.schema[id_col].dataType.simpleString()

    def setup():
        hashes = _Hashes()

        def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
            found = [vector(t, bits, hashes) for t in piece.column(2).to_pylist()]
            packed = [pa.array([v[k].astype("<u4").tobytes() for v in found], pa.binary()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *packed], names=names)

        return apply

    rows = map_texts(single, ["_sl_doc", "_sl_y", "_sl_text"], None, f"_sl_doc {kind}, _sl_y int, _sl_index binary, _sl_count binary", setup).collect()
    rows.sort(key=lambda r: hashlib.md5(str(r[0]).encode()).digest())
    return [(np.frombuffer(r[2], "<u4"), np.frombuffer(r[3], "<u4")) for r in rows], [r[1] for r in rows]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 3000, bits: int = 18, **options) -> QualityModel:
    """The model of the labelled documents that aren't held out; ``max_rows`` bounds the number of rows it is fitted on."""
    vectors, y = labelled_sample(docs, labels, id_col, text_col, label_col, max_rows, bits)
    return fit_vectors(vectors, y, bits, **options)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        own, hashes = shared.value, _Hashes()

        def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
            scores = [own.score(t, hashes) for t in piece.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

        return apply

    return map_texts(docs, [id_col, text_col], None, f"`{id_col}` {kind}, score double", setup)


def op6_quality_classifier(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
