"""Toxicity by a weighted lexicon.

Text is lower-cased and folded (homoglyphs to Latin letters, digits and signs
that stand for letters inside a word to those letters); one Aho-Corasick pass
finds lexicon terms and exception phrases; a term counts between word
boundaries and outside every exception. The summed weights and their rate by
text length go through a logistic curve.

The lexicon is a list of seed insults, whose weights the labelled rows correct
where they hold them often enough, plus terms learned from these rows: Spark
counts their words by label, and how often a term must occur and how much more
often in toxic rows is chosen by cross-validation among the training rows
(copies of one text fall in one fold). The curve is fitted on the same rows.
Learning uses at most ``max_rows`` labelled rows (those of least hash of
doc_id), whole texts, and never sees language, source or doc_id as an input.
What reaches the driver is bounded by ``max_rows`` and ``max_terms``.

Definite results: null or empty text has the score of a text without hits; a
document of no label is scored like any other; a document labelled both ways
counts once for each label in training, repeated labels count once, and of
rows that share a labelled doc_id the one of least text counts; an empty table
of labels leaves the seeds and a fixed curve; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import blocks as B
from tessera.runtime import Workspace

#: Seed terms and weights: common English insults.
SEEDS = {
    "idiot": 1.0, "idiots": 1.0, "moron": 1.0, "morons": 1.0, "stupid": 0.8, "dumb": 0.8, "loser": 0.8, "losers": 0.8, "scum": 1.0, "trash": 0.7, "pathetic": 0.8, "worthless": 0.8,
    "disgusting": 0.7, "clown": 0.7, "clowns": 0.7, "imbecile": 1.0, "cretin": 1.0, "vermin": 1.0, "filth": 0.8, "garbage": 0.6, "retard": 1.2, "bastard": 1.0, "bitch": 1.2,
    "asshole": 1.2, "shit": 0.9, "fuck": 1.2, "fucking": 1.2, "whore": 1.2, "slut": 1.2, "dickhead": 1.2, "jerk": 0.6, "degenerate": 0.8, "subhuman": 1.2, "parasite": 0.6, "maggot": 0.9,
}
#: Phrases in which a term is no insult.
EXCEPTIONS = ("class clown", "clown fish", "clown car", "trash can", "trash bag", "garbage collection", "garbage collector", "garbage can", "idiot proof", "pathetic fallacy", "white trash can", "sore loser", "knee jerk", "jerk chicken", "parasite drag", "degenerate case", "degenerate matter", "stupid simple")
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнԛԝɡαβεικνορτυχωѵℓ", "aeopcyxijsdhkmtbhqwgabeiknoptuxwvl", strict=True))
#: Signs that stand for letters inside a word.
SIGNS = dict(zip("0134578@$!|", "oleastbasil", strict=True)) | {"1": "i"}
_PLAIN = str.maketrans(HOMOGLYPHS)
_DIGITS = str.maketrans(SIGNS)
_MARKS = re.compile("[\u0300-\u036f]+")
_ODD = re.compile(r"[^\s0134578@$!|]*[0134578@$!|]\S*")


def _bare(word: str) -> str:
    """A word without marks around it; signs that may stand for its first letter stay."""
    return word.strip(".,;:?\"'()").rstrip("!|.,;:?")



def fold(text: str) -> str:
    """Lower case, homoglyphs and accents folded; a word of letters and signs has its signs read as letters."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(_PLAIN)
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
    return t


def _letters(word: str) -> bool:
    return any(c.isalpha() for c in word) and any(c in SIGNS for c in word)


def words(text: str) -> set[str]:
    """Distinct folded words, for learning."""
    out = set()
    for w in fold(text).split():
        if not w.isalpha() and _letters(_bare(w)):
            w = _bare(w).translate(_DIGITS)
        out.add("".join(c for c in w if c.isalnum()))
    out.discard("")
    return out


@dataclass(frozen=True)
class Model:
    """Lexicon, exceptions and the fitted curve."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-2.5, 3.0, 1.0)
    _built: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "curve": self.curve, "_built": []}

    def automaton(self):
        if not self._built:
            a = ahocorasick.Automaton()
            for t, w in self.terms.items():
                a.add_word(t, (len(t), w))
            for t in self.exceptions:
                a.add_word(t, (len(t), 0.0))
            a.make_automaton()
            self._built.append(a)
        return self._built[0]

    def hits(self, text: str) -> tuple[float, int]:
        """Total weight of the counted hits, and their number."""
        t = fold(text)
        total, n = self._scan(t)
        odd = [w for w in map(_bare, _ODD.findall(t)) if _letters(w)]
        if odd:  # words that hold signs are read once more, as letters
            plain, _ = self._scan(" ".join(odd))
            more, k = self._scan(" ".join(odd).translate(_DIGITS))
            if more > plain:
                total, n = total + more - plain, n + k
        return total, n

    def _scan(self, t: str) -> tuple[float, int]:
        found, free = [], []
        for end, (size, w) in self.automaton().iter(t):
            start = end - size + 1
            if (start and t[start - 1].isalnum()) or (end + 1 < len(t) and t[end + 1].isalnum()):
                continue
            (found if w else free).append((start, end, w))
        if free:
            found = [(a, b, w) for a, b, w in found if not any(x <= a and b <= y for x, y, _ in free)]
        return sum(w for *_, w in found), len(found)

    def features(self, text: str | None) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        total, _ = self.hits(text)
        rate = total / (1 + len(text) / 600)  # about a hundred words
        return math.log1p(total), math.log1p(rate)

    def score(self, text: str | None) -> float:
        x, y = self.features(text)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; slopes are kept from falling below zero."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    free = np.array([True, True, True])
    for _ in range(2):
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (p - y) + ridge * np.array([0, w[1], w[2]])
            h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, ridge, ridge])
            step = np.zeros(3)
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        low = (w < 0) & np.array([False, True, True])
        if not low.any():
            break
        w, free = np.zeros(3), free & ~low
    return tuple(float(v) for v in w)


def held_out_by_crc(id_col: str, mod: int, rest: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % mod == rest


#: What cross-validation chooses from: toxic rows that hold a term, and how many times its share there is that of the other rows.
LEAST_ROWS = (2, 3, 4, 6, 9)
LEAST_RATIO = (3.0, 5.0, 8.0, 12.0, 20.0, 35.0)


def _weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, least: int, ratio: float) -> np.ndarray:
    """Weight of each term by the rows that hold it; 0 where it tells too little."""
    r = (toxic / max(1.0, n_toxic)) / ((clean + 0.5) / max(1.0, n_clean))
    return np.where((toxic >= least) & (r >= ratio), np.minimum(1.2, np.log(np.maximum(r, 1.0)) / 4), 0.0)


def _choose(toxic: np.ndarray, clean: np.ndarray, seeds: np.ndarray, rows: list, folds: int) -> tuple[int, float]:
    """(least rows, least ratio) of the best F1, then the least loss, over rows whose fold was not learned from.

    ``toxic`` and ``clean`` count rows by term and fold; ``rows`` are (fold, label, characters, terms).
    """
    fold = np.array([r[0] for r in rows])
    y = np.array([r[1] for r in rows], dtype=float)
    size = np.array([r[2] for r in rows], dtype=float)
    n = np.array([len(r[3]) for r in rows])
    term = np.concatenate([np.asarray(r[3], dtype=np.int64) for r in rows]) if len(rows) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), n)
    best = None
    for least in LEAST_ROWS:
        for ratio in LEAST_RATIO:
            p = np.zeros(len(rows))
            for k in range(folds):
                own = fold != k
                w = _weights(toxic.sum(1) - toxic[:, k], clean.sum(1) - clean[:, k], y[own].sum(), (1 - y[own]).sum(), least, ratio)
                total = np.bincount(owner, weights=np.where(w > 0, w, seeds)[term], minlength=len(rows))
                x = np.column_stack([np.log1p(total), np.log1p(total / (1 + size / 600))])
                if own.any() and 0 < y[own].sum() < own.sum():
                    a = np.array(_fit(x[own], y[own]))
                    p[~own] = 1 / (1 + np.exp(-np.clip(a[0] + x[~own] @ a[1:], -30, 30)))
            hit = ((p >= 0.5) & (y == 1)).sum()
            f1 = 2 * hit / max(1.0, (p >= 0.5).sum() + y.sum())
            loss = -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1)).mean()
            new = (f1, -loss, ratio, least)
            best = new if best is None or new > best else best
    return best[3], best[2]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: Column | None = None, max_rows: int = 6000, max_terms: int = 3000, folds: int = 4) -> Model:
    """Fit on labelled rows outside ``held_out``; at most ``max_rows`` of them are read."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y IN (0, 1)")
    if held_out is not None:
        rows = labels.where(~held_out).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y IN (0, 1)")
    rows = rows.distinct().orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)  # a bounded sample, so its broadcast is bounded
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    chosen = texts.join(F.broadcast(rows), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("text"))
    chosen = chosen.select(F.col("_y").alias("y"), F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("fold"), "text")
    ws = Workspace(docs.sparkSession)
    chosen = ws.keep(chosen, "labelled")

    def count(batches):
        for b in batches:
            seen: dict[tuple[str, int, int], int] = {}
            for y, fold, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for w in words(t):
                    if 3 <= len(w) <= 40:
                        seen[w, y, fold] = seen.get((w, y, fold), 0) + 1
            cols = list(zip(*seen, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, list(seen.values())], (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["word", "y", "fold", "n"])

    by_label = chosen.mapInArrow(B.released(count), "word string, y int, fold int, n long").groupBy("word")
    sums = [F.sum(F.when((F.col("y") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"c{y}_{k}") for y in (0, 1) for k in range(folds)]
    counted = by_label.agg(*sums).withColumn("toxic", sum(F.col(f"c1_{k}") for k in range(folds))).withColumn("clean", sum(F.col(f"c0_{k}") for k in range(folds)))
    size = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ratio = F.col("toxic") / size.get(1, 1) / ((F.col("clean") + 0.5) / size.get(0, 1))
    loose = counted.where((F.col("toxic") >= LEAST_ROWS[0]) & (ratio >= LEAST_RATIO[0]) | F.col("word").isin(list(SEEDS)))
    known = loose.orderBy(F.desc(F.col("toxic") * F.log(1 + ratio)), "word").limit(max_terms).collect()
    index = {r["word"]: i for i, r in enumerate(known)}

    def held(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            found = [[index[w] for w in words(t) if w in index] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["fold", "y", "size", "terms"])

    terms = dict(SEEDS)
    if known and len(size) == 2:
        table = [tuple(r) for r in chosen.mapInArrow(held, "fold int, y int, size long, terms array<int>").collect()]  # max_rows rows of at most max_terms numbers
        toxic, clean = (np.array([[r[f"c{y}_{k}"] for k in range(folds)] for r in known], dtype=float) for y in (1, 0))
        seeds = np.array([SEEDS.get(r["word"], 0.0) for r in known])
        w = _weights(toxic.sum(1), clean.sum(1), size[1], size[0], *_choose(toxic, clean, seeds, sorted(table), folds))
        terms |= {r["word"]: float(x) for r, x in zip(known, w, strict=True) if x > 0}
    model = Model(terms)
    if len(size) < 2:
        return model

    def features(batches):
        for b in batches:
            got = [model.features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], ["y", "total", "rate"])

    x = np.array(sorted(tuple(r) for r in chosen.mapInArrow(B.released(features), "y int, total double, rate double").collect()))  # max_rows rows of three numbers
    ws.drop(chosen)
    return Model(terms, curve=_fit(x[:, 1:], x[:, 0]))


def scorer(model: Model):
    """A column function: the score of a text."""

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        scores = [model.score(t.as_py()) for t in text]
        B.release()
        return pa.array(scores, pa.float64())

    return score


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), scorer(model)(F.col(text_col).cast("string")).alias("score"))
