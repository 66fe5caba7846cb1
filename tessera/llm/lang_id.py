"""Language identification by averaged hashed subword embeddings.

A text is lower-cased; letters stand, everything else is a word boundary.
Its character pairs and triples within words (boundaries included) are hashed
to rows of an embedding table; their average goes through a linear softmax.
Table and softmax are trained by stochastic gradient descent in numpy on at
most ``max_rows`` labelled rows (those of least hash of doc_id), whole texts.
A fifth of these are kept back to fit the temperature that calibrates the
score and the score under which a prediction is marked as rejected.

Definite results: null text, or text without a letter, is ``und`` with score
0 and rejected; so is every text where there was nothing to learn from (no row,
no label, no letter); ties go to the language that sorts first; of rows that
share a doc_id the one of least language and text is learned from; rows that
repeat are judged each; further columns of any name are ignored. Language, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B

SPAN = 1 << 15  # rows of the embedding table


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed subwords of all texts, the text each belongs to, and whether each text has a letter."""
    joined = "\n".join([t.lower() for t in texts]) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[raw]
    size = np.array([len(t.lower()) + 1 for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    c = np.where(letter, raw, 0).astype(np.uint32)
    some = np.zeros(len(texts), dtype=bool)
    some[owner[letter]] = True
    # a pair or triple is used if one of its first two places is a letter; texts end with a boundary
    a = np.concatenate([[np.uint32(0)], c[:-1]])
    b, d = c, np.concatenate([c[1:], [np.uint32(0)]])
    use = letter
    pair = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
    triple = (pair ^ (d * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    h = np.concatenate([(pair >> np.uint32(17))[use], (triple >> np.uint32(17))[use]]).astype(np.int64)
    o = np.concatenate([owner[use], owner[use]])
    return h & (SPAN - 1), o, some


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # embedding times softmax weights: what one subword adds to each language
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.5

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h, o, some = subwords(texts)
        n = np.maximum(1, np.bincount(o, minlength=len(texts)))
        out = np.stack([np.bincount(o, weights=self.table[h, k], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        return out / n[:, None] + self.bias, some

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        names, scores = [], []
        at = 0
        while at < len(texts):  # slices of about 500,000 characters
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") < 500_000):
                size += len(texts[to] or "")
                to += 1
            z, some = self.logits([t or "" for t in texts[at:to]])
            p = softmax(z / self.temperature)
            best = p.argmax(1)
            names += [self.languages[k] if ok else "und" for k, ok in zip(best.tolist(), some.tolist(), strict=True)]
            scores.append(np.where(some, p[np.arange(len(p)), best], 0.0))
            at = to
        return names, np.concatenate(scores) if scores else np.empty(0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[str], langs: list[str], *, dim: int = 16, epochs: int = 6, rate: float = 2.0, seed: int = 11, precision: float = 0.98) -> Model:
    """Train by stochastic gradient descent, one document a step."""
    languages = tuple(sorted(set(langs)))
    rng = np.random.Generator(np.random.PCG64(seed))
    y = np.array([languages.index(x) for x in langs])
    docs = []
    for t in texts:
        h, _, some = subwords([t])
        docs.append(np.unique(h, return_counts=True) if some[0] else None)
    usable = np.array([i for i, d in enumerate(docs) if d is not None], dtype=np.int64)
    if not len(usable):
        return Model((), np.zeros((SPAN, 0)), np.zeros(0))
    usable = rng.permutation(usable)
    n_cal = len(usable) // 5
    cal, own = usable[:n_cal], usable[n_cal:]
    emb = rng.normal(0, 0.1, (SPAN, dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (dim, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    steps, step = max(1, epochs * len(own)), 0
    for _ in range(epochs):
        for i in rng.permutation(own):
            idx, times = docs[i]
            share = (times / times.sum()).astype(np.float32)
            eta = np.float32(rate * (1 - step / steps))
            step += 1
            mean = share @ emb[idx]
            g = softmax(mean @ w + bias)
            g[y[i]] -= 1
            back = w @ g
            w -= eta * 0.1 * np.outer(mean, g)
            bias -= eta * 0.01 * g
            emb[idx] -= eta * np.sqrt(share)[:, None] * back[None, :] * np.float32(0.5)
    model = Model(languages, (emb @ w).astype(np.float64), bias.astype(np.float64))
    if not len(cal):
        return model
    z = np.stack([((docs[i][1] / docs[i][1].sum()) @ model.table[docs[i][0]]) + model.bias for i in cal])
    grid = np.geomspace(0.2, 20, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(cal)), y[cal]] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(z / t)
    top, right = p.max(1), p.argmax(1) == y[cal]
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    cut = float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return Model(languages, model.table, model.bias, t, cut)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, max_rows: int = 3000) -> Model:
    """Fit on labelled rows outside ``held_out``; at most ``max_rows`` rows reach the driver."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if held_out is not None:
        rows = rows.where(~held_out)
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))
    ids = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(max_rows).distinct()
    got = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min(F.struct("l", "t")).alias("r")).select("id", "r.*")  # max_rows rows at most
    pairs = sorted((r["id"], r["l"], r["t"]) for r in got.toLocalIterator())
    return fit([p[2] for p in pairs], [p[1] for p in pairs])


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SPAN rows by languages: a fixed size

    def run(batches):
        for b in (part for whole in batches for part in B.by_bytes(whole, 1, 4 << 20)):
            names, scores = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(scores < shared.value.reject_below, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(B.released(run), "doc_id long, lang_pred string, score double, rejected boolean")
