"""Relational TF-IDF, and vectors for the estimators."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.relational import join_groups

PORTION = 1 << 21  # bytes of words that a task counts at a time


def words_of(text: Column) -> Column:
    """Word tokens divided by single spaces: the form that tasks count terms in."""
    return F.array_join(tokens(text), " ")


class Counts:
    """Terms of some documents: row, number in ``names`` and count of every term of a row, by row and number."""

    def __init__(self, words: pa.Array, bigrams: bool = False):
        lists = pc.split_pattern(words, " ")
        row = np.repeat(np.arange(len(words)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        coded = lists.flatten().dictionary_encode()
        code, self.names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        if (none := self.names.index("").as_py()) >= 0:  # a text without words
            row, code = row[code != none], code[code != none]
        n = len(self.names)
        if bigrams and len(code) > 1:
            inside = row[1:] == row[:-1]
            pair, at = np.unique(code[:-1][inside] * n + code[1:][inside], return_inverse=True)
            two = pc.binary_join_element_wise(self.names.take(pa.array(pair // n)), self.names.take(pa.array(pair % n)), " ")
            self.names = pa.concat_arrays([self.names, two])
            row, code = np.concatenate([row, row[1:][inside]]), np.concatenate([code, n + at])
        self.row, self.term, self.tf = self._once(row, code, len(self.names))

    @staticmethod
    def _once(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, tf = np.unique(row * max(n, 1) + code, return_counts=True)
        return key // max(n, 1), key % max(n, 1), tf

    def known(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in ``terms`` and count of the terms that ``terms`` holds, by row and place."""
        at = np.asarray(pc.fill_null(pc.index_in(self.names, value_set=terms), -1)).astype(np.int64)[self.term]
        own = at >= 0
        order = np.lexsort((at[own], self.row[own]))
        return self.row[own][order], at[own][order], self.tf[own][order]


def portions(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``PORTION`` bytes of a column; a longer row is alone."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), dtype=np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, side="right")))
            yield b.slice(at, to - at)
            at = to


def term_counts(docs: DataFrame, text: str, bigrams: bool = False) -> DataFrame:
    """record_id, term, tf. A row's terms are counted where the row is; only if ids repeat do counts meet in an exchange."""

    def run(batches):
        for b in portions(batches, "words"):
            c = Counts(b.column("words"), bigrams)
            yield pa.RecordBatch.from_arrays([b.column("record_id").take(pa.array(c.row)), c.names.take(pa.array(c.term)), pa.array(c.tf, pa.int64())], ["record_id", "term", "tf"])

    got = docs.select("record_id", words_of(F.col(text)).alias("words")).mapInArrow(run, f"record_id {dict(docs.dtypes)['record_id']}, term string, tf long")
    if docs.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return got
    return got.groupBy("record_id", "term").agg(F.sum("tf").alias("tf"))


def term_totals(docs: DataFrame, text: str, bigrams: bool = False) -> DataFrame:
    """term, df, total over all rows of ``docs``, added up over portions of rows before they are exchanged."""

    def run(batches):
        for b in portions(batches, "words"):
            c = Counts(b.column("words"), bigrams)
            n = len(c.names)
            yield pa.RecordBatch.from_arrays([c.names, pa.array(np.bincount(c.term, minlength=n), pa.int64()), pa.array(np.bincount(c.term, c.tf, n).astype(np.int64))], ["term", "df", "total"])

    got = docs.select(words_of(F.col(text)).alias("words")).mapInArrow(run, "term string, df long, total long")
    return got.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where("df > 0")


def most_frequent(totals: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """The most frequent of (term, df, total) by total count (ties: term order)."""
    v = totals.where(F.col("df") >= min_df)
    return v if max_features is None else v.orderBy(F.desc("total"), "term").limit(max_features)


def vectors(docs: DataFrame, text: str, terms: list[str], idf: np.ndarray, bigrams: bool = False, sublinear: bool = False) -> DataFrame:
    """``docs`` with, in place of ``text``, numbers ``i`` and values ``x`` of the terms that each row holds: TF-IDF of unit length, made where the row is."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, idf))
    own = [c for c in docs.columns if c != text]

    def run(batches):
        terms, idf = pa.array(shared.value[0], pa.string()), shared.value[1]
        for b in portions(batches, "words"):
            row, at, tf = Counts(b.column("words"), bigrams).known(terms)
            x = (1 + np.log(tf) if sublinear else tf) * idf[at]
            x = x / np.sqrt(np.bincount(row, x * x, b.num_rows))[row]
            ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(x, pa.float64()))], [*own, "i", "x"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in own], "i array<int>", "x array<double>"])
    return docs.select(*own, words_of(F.col(text)).alias("words")).mapInArrow(run, schema)


def vocabulary(counts: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """term, df, total: the most frequent terms by total count (ties: term order)."""
    return most_frequent(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), min_df, max_features)


def tfidf(counts: DataFrame, vocab: DataFrame, n_docs: int, sublinear: bool = False, large: bool = False) -> DataFrame:
    """record_id, term, tfidf with smooth idf, rows of unit length.

    ``large``: a vocabulary without a bound, met by term; terms of many
    documents are few and broadcast.
    """
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    own = vocab.select("term", "df")
    met = join_groups(counts, own, ["term"], "df").where("df IS NOT NULL") if large else counts.join(own, "term")
    w = met.withColumn("x", tf * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1))
    return w.select("record_id", "term", (F.col("x") / F.sqrt(F.sum(F.col("x") ** 2).over(Window.partitionBy("record_id")))).alias("tfidf"))


def grid() -> list[dict]:
    """The eight text representations, in the order that breaks ties. The three grids."""
    return [dict(ngrams=(1, 2), max_features=m, min_df=d, sublinear=s) for m, d, s in product((10_000, 20_000), (5, 2), (False, True))]


def candidates() -> list[dict]:
    """Majority, then 24 logistic regressions and 24 linear machines: weak regularisation last."""
    own = [dict(representation=r, c=c) for r in grid() for c in (0.1, 1.0, 10.0)]
    return [dict(model="majority")] + [dict(model=m, **x) for m in ("logistic_regression", "linear_svm") for x in own]
