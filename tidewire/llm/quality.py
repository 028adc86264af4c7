"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are single words and word pairs of the whole text (ASCII letters lower-cased), hashed to ``2 ** bits``
weights; a feature's value is its count, damped by a square root, over the length of the document's vector. Workers turn
texts into sparse vectors. The training sample has a bound, ``sample`` labelled documents by smallest hash of their id,
so the updates run on the driver over bounded data; the weights (1 MB) are the only thing sent out. Scores are sparse dot
products through the logistic function.

Defined results: null and empty texts have no features, so their score is the intercept's. A row without doc_id is
scored and never trained on. Without labelled rows of both kinds every score is the labels' mean, or 0.5. Rows that
repeat are scored each; labels that repeat count once (the smallest). Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, held_out, lists, mix, released, text_bytes

BITS = 18


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers and values of a text's sparse vector."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    h = WORDS.of(words)
    grams = np.concatenate([mix(h), mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])]) >> np.uint64(64 - bits)
    index, n = np.unique(grams, return_counts=True)
    value = np.sqrt(n)
    return index.astype(np.int64), value / np.sqrt((value * value).sum())


def _vectors(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [features(t.as_py(), bits) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([lists([i for i, _ in both], pa.int32()), lists([v for _, v in both], pa.float32()), b.column(1)], ["index", "value", "label"])

    return run


def _slices(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column as views of one numpy array a chunk, without a Python object for each number."""
    out = []
    for chunk in column.chunks:
        values, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], *, bits: int = BITS, epochs: int = 10, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept, by per-coordinate FTRL-proximal updates, one row at a time in a fixed order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(i):
        return np.where(np.abs(z[i]) <= l1 * (i < size - 1), 0.0, (np.sign(z[i]) * l1 * (i < size - 1) - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for epoch in range(epochs):
        for at in np.random.default_rng(epoch).permutation(len(rows)):
            index, value, label = rows[at]
            i, x = np.append(index, size - 1), np.append(value, 0.2)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weight(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1] * 0.2)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = 6000, bits: int = BITS, folds: int = 5) -> tuple[np.ndarray, float]:
    """Learns from labelled rows outside the held-out fold: ``sample`` of them at most, by smallest hash of doc_id, each document once."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = marks.filter(~held_out(F.col("doc_id"), folds)).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = texts.orderBy("doc_id").select(text_bytes(F.col("text")).alias("text"), "label").mapInArrow(_vectors(bits), "index array<int>, value array<float>, label int").toArrow()  # ``sample`` rows
    index, value = _slices(got["index"]), _slices(got["value"])
    rows = list(zip(index, value, got["label"].to_pylist(), strict=True))
    del got
    seen = {y for _, _, y in rows}
    if len(seen) < 2:
        return np.zeros(1 << bits, np.float32), {0: -30.0, 1: 30.0}.get(next(iter(seen), None), 0.0)
    return train(rows, bits=bits)


def score(docs: DataFrame, weights: np.ndarray, intercept: float, *, keep: tuple[str, ...] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the score of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            dots = [float(w[i] @ v) for i, v in (features(t.as_py(), bits) for t in b.column("__bytes"))]
            values = 1 / (1 + np.exp(-np.clip(np.array(dots, np.float64) + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(values)], [*keep, "__score"])

    schema = docs.select(*keep).schema.add("__score", "double")
    return docs.select(*keep, text_bytes(F.col("text")).alias("__bytes")).mapInArrow(released(run), schema)


def classify(docs: DataFrame, labels: DataFrame, *, cutoff: float = 0.3, folds: int = 5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    weights, intercept = fit(docs, labels, folds=folds, **options)
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), weights, intercept)
    return found.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= cutoff).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, cutoff: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    weights, intercept = fit(docs, labels, **options)
    return score(docs, weights, intercept, keep=tuple(docs.columns)).filter(F.col("__score") >= cutoff).drop("__score")
