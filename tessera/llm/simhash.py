"""SimHash fingerprints and Golay-code fuzzy joins.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Two
fingerprints at most two bits apart have a segment without error, and in
every segment at most two errors, so they agree exactly on some segment and
share a Golay key (one of up to six near codewords) on the next one. Keys
join on those 35 bits; the distance is then verified.

Small key groups are compared in full. In a group of more than ``most``
fingerprints no pairs are made: each fingerprint emits itself and its
one-bit neighbours, and those that meet on a neighbour are at most two apart
(and conversely), which links exactly the same fingerprints through stars.
Identical fingerprints are one node, so copies never make pairs.

Definite results: null or empty text has fingerprint zero, linked like any
other; a null doc_id is never the smallest; rows with one doc_id are separate
rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import blocks as B
from tessera.llm.golay import near_keys
from tessera.operators.graph import connected_components
from tessera.runtime import Workspace

SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: bytes, words: int) -> int:
    """Majority bits of the XXH64 (seed 42) of every shingle, repeats included."""
    w = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    line = b" ".join(w)
    end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])[: len(w) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], 42) for a, b in zip(start, end[words - 1 :].tolist(), strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in B.texts_of(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


@F.arrow_udf(T.ArrayType(T.LongType()))
def exact_and_golay_keys(fp: pa.Array) -> pa.Array:
    """Keys of a fingerprint for distance two: one exact segment and a near codeword of the next."""
    x = np.asarray(fp.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)
    seg = [((x >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    cols = [((i << 35) | (seg[i] << 12))[:, None] | near_keys(seg[(i + 1) % 3]) for i in range(3)]
    k = np.sort(np.concatenate(cols, axis=1), axis=1)
    new = np.ones(k.shape, dtype=bool)
    new[:, 1:] = k[:, 1:] != k[:, :-1]
    offsets = np.concatenate([[0], np.cumsum(new.sum(1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(k[new]))


def links_within_two(fps: DataFrame, *, most: int = 64) -> DataFrame:
    """Links (src, dst) that connect distinct fingerprints ``fp`` at most two bits apart, and no others."""
    keyed = fps.select("fp", F.explode(exact_and_golay_keys("fp")).alias("key"))
    w = Window.partitionBy("key").orderBy("fp")
    near = keyed.withColumn("next", F.collect_list("fp").over(w.rowsBetween(1, most - 1))).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    near = near.withColumn("next", F.filter("next", lambda y: F.bit_count(F.col("fp").bitwiseXOR(y)) <= 2))
    small = near.where(f"n <= {most}").select(F.col("fp").alias("src"), F.explode("next").alias("dst"))
    ball = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    stars = near.where(f"n > {most}").select("fp").distinct().select("fp", F.explode(ball).alias("z"))
    heads = stars.groupBy("z").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    hot = stars.join(heads, "z").where("fp <> head").select(F.col("fp").alias("src"), F.col("head").alias("dst"))
    return small.union(hot).distinct()


def simhash_groups(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id, n_links.

    component_id is the smallest doc_id reachable over links of two bits or
    fewer; n_links counts the links found from the row's fingerprint.
    """
    ws = Workspace(docs.sparkSession)
    rows = ws.keep(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    links = ws.keep(links_within_two(nodes.select("fp")), "links")
    part = connected_components(links)
    named = nodes.join(part, nodes["fp"] == part["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    degree = links.select(F.explode(F.array("src", "dst")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    named = named.join(least, "component").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
