"""Topic mixtures of two cohorts by non-negative factors of pooled TF-IDF."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.features import most_frequent, term_totals, vectors
from tessera.operators.sums import summed
from tessera.runtime import Workspace


class Weighted:
    """One batch of documents with its non-negative weights for fixed topics, by multiplicative steps on all of them together."""

    def __init__(self, batch: pa.RecordBatch, h: np.ndarray, steps: int = 30):
        lists, n = batch.column("i"), batch.num_rows
        self.row = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
        self.i, self.x = np.asarray(lists.flatten()).astype(np.int64), np.asarray(batch.column("x").flatten())
        num = np.stack([np.bincount(self.row, self.x * t[self.i], n) for t in h], axis=1)
        hht = h @ h.T
        self.w = np.repeat(np.bincount(self.row, self.x, n)[:, None] / max(1e-12, h.sum()), len(h), axis=1)
        for _ in range(steps):
            self.w *= num / (self.w @ hht + 1e-12)

    def sums(self, m: int) -> np.ndarray:
        """Σ w xᵀ and Σ w wᵀ over the documents, side by side."""
        return np.concatenate([np.stack([np.bincount(self.i, t[self.row] * self.x, m) for t in self.w.T]), self.w.T @ self.w], axis=1)


def topic_proxy(docs: DataFrame, side: str, *, topics: int = 10, max_features: int = 5000, rounds: int = 12, seed: int = 613) -> tuple[DataFrame, DataFrame]:
    """(mixtures, terms): record_id, side, weights of every document; top terms of every topic.

    Topics by terms is a matrix of at most ``topics`` x ``max_features``
    numbers: it goes to the tasks, their sums meet in groups, and the driver
    updates it. Documents stay where they are.
    """
    from pyspark.ml.feature import StopWordsRemover

    spark = docs.sparkSession
    stop = StopWordsRemover.loadDefaultStopWords("english")
    n = docs.count()
    ws = Workspace(spark, rest=2.0)
    told = term_totals(docs, "text", bigrams=True).where(~F.split("term", " ")[0].isin(stop) & ~F.element_at(F.split("term", " "), -1).isin(stop))
    vocab = most_frequent(told, 2 if n > 20 else 1, max_features)
    vocab = ws.keep(vocab.where(F.col("df") <= 0.95 * n) if n > 20 else vocab, "vocabulary")
    known = vocab.select("term", "df").orderBy("term").collect()  # max_features rows
    names = [r["term"] for r in known]
    if not names:
        empty = docs.select("record_id", side, F.array().cast("array<double>").alias("weights"))
        return empty, spark.createDataFrame([], "topic int, rank int, term string")
    idf = np.log((1 + n) / (1 + np.array([r["df"] for r in known]))) + 1
    rows = ws.keep(vectors(docs.select("record_id", side, "text"), "text", names, idf, bigrams=True, sublinear=True), "rows")
    k, m = min(topics, n, len(names)), len(names)
    h = np.random.Generator(np.random.PCG64(seed)).random((k, m)) + 0.01

    def sums(batches, h: np.ndarray) -> np.ndarray:
        return sum((Weighted(b, h).sums(m) for b in batches), np.zeros((k, m + k)))

    for _ in range(rounds):
        got = summed(rows.select("i", "x"), partial(sums, h=h), (k, m + k))
        h = h * got[:, :m] / (got[:, m:] @ h + 1e-12)
        h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)

    def mix(batches):
        for b in batches:
            w = Weighted(b, h).w
            yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column(side), pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel()))], ["record_id", side, "weights"])

    kinds = dict(rows.dtypes)
    mixtures = rows.mapInArrow(mix, f"record_id {kinds['record_id']}, {side} {kinds[side]}, weights array<double>")
    top = [(t, r + 1, names[j]) for t in range(k) for r, j in enumerate(np.argsort(-h[t], kind="stable")[:10].tolist())]
    return mixtures, spark.createDataFrame(top, "topic int, rank int, term string")
