"""Approximate nearest-neighbour graphs of vectors by random projections.

Every tree signs the vectors by random hyperplanes (through medians), sorts
them by the bits and a last projection, and cuts the order into blocks; rows
of a block are compared in full. The best of all trees are kept, and rounds of
refinement compare a vector with the neighbours of its neighbours. Every vector
is indexed; blocks have a fixed size, so neither copies nor a dense region
make a large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sums import summed
from tessera.runtime import Workspace

MOST_TASKS = 4096


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of numbers, all of one length."""
    if not len(column):
        return np.empty((0, 0))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x and y."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0.0))


def _medians(vectors: DataFrame, planes: np.ndarray) -> np.ndarray:
    """About the median of every projection: between the mean's neighbours in a histogram over all vectors."""
    d = planes.shape[1]
    n, mean, square = np.split(summed(vectors, lambda bs: sum((np.concatenate([[b.num_rows], (p := matrix(b.column("v")) @ planes).sum(0), (p * p).sum(0)]) for b in bs if b.num_rows), np.zeros(1 + 2 * d)), (1 + 2 * d,)), [1, 1 + d])
    mean, sd = mean / n, np.sqrt(np.maximum(square / n - (mean / n) ** 2, 0)) + 1e-12
    edges = np.linspace(-2, 2, 257)

    def bins(bs):
        out = np.zeros((d, 258))
        for b in bs:
            if b.num_rows:
                at = np.searchsorted(edges, ((matrix(b.column("v")) @ planes) - mean) / sd)
                for j in range(d):
                    out[j] += np.bincount(at[:, j], minlength=258)
        return out

    up = np.cumsum(summed(vectors, bins, (d, 258)), axis=1)
    at = np.clip((up < n / 2).sum(1), 0, 256)
    return mean + sd * edges[at]


def _best(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, distance): the k nearest of every row within the block."""
    k = min(k, len(ids) - 1)
    if k < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    exact = np.concatenate([np.sqrt(((x[near[i : i + 64]] - x[i : i + 64, None, :]) ** 2).sum(2)) for i in range(0, len(ids), 64)])
    return np.repeat(ids, k), ids[near].ravel(), exact.ravel()


def _rows(ids, others, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(d, pa.float64())], ["id", "other", "d"])


def nearest_of(pairs: DataFrame, k: int) -> DataFrame:
    """The k smallest distances of every id (ties: smaller other), each other once; k rows of an id leave a task."""
    rank = Window.partitionBy("id").orderBy("d", "other")
    once = pairs.groupBy("id", "other").agg(F.min("d").alias("d"))
    return once.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= k).select("id", "other", "d")


def neighbour_graph(vectors: DataFrame, k: int = 15, *, trees: int = 8, bits: int = 24, block: int = 1000, refine: int = 1, seed: int = 613) -> DataFrame:
    """(id, other, d): about the k nearest others of every vector. ``vectors`` has id (long, unique) and v (equal lengths)."""
    ws = Workspace(vectors.sparkSession, rest=2.0)
    first = vectors.select("v").first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "id long, other long, d double")
    dim, n = len(first["v"]), vectors.count()
    planes = np.random.default_rng(seed).standard_normal((dim, trees * (bits + 1)))
    median = _medians(vectors, planes)
    spark = vectors.sparkSession
    tasks = int(np.clip(-(-n // (8 * block)), 1, MOST_TASKS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(block - size, b.num_rows - at)
                held.append(b.slice(at, take))
                at, size = at + take, size + take
                if size == block:
                    t = pa.Table.from_batches(held).combine_chunks()
                    yield _rows(*_best(t.column("id").to_numpy(), matrix(t.column("v").chunk(0)), k))
                    held, size = [], 0
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield _rows(*_best(t.column("id").to_numpy(), matrix(t.column("v").chunk(0)), k))

    out = None
    for t in range(trees):
        own = slice(t * (bits + 1), (t + 1) * (bits + 1))
        p, m = planes[:, own], median[own]

        def sign(batches, p=p, m=m):
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column("v")) @ p - m
                    key = ((x[:, :bits] > 0) @ (1 << np.arange(bits - 1, -1, -1))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(key), pa.array(x[:, bits])], ["id", "v", "key", "along"])

        signed = vectors.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(sign, "id long, v array<double>, key long, along double")
        found = signed.repartitionByRange(tasks, "key", "along", "id").sortWithinPartitions("key", "along", "id").mapInArrow(cut, "id long, other long, d double")
        out = found if out is None else out.unionByName(found)
    graph = ws.keep(nearest_of(out, k), "neighbours")
    for _ in range(refine):
        both = graph.select("id", "other").union(graph.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
        # a hub keeps as many backward links as any vector has forward ones, spread by a hash
        rank = Window.partitionBy("id").orderBy(F.xxhash64("other"), "other")
        some = both.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= 2 * k).drop("rn")
        pairs = some.alias("a").join(some.alias("b"), F.col("a.id") == F.col("b.id")).where("a.other < b.other").select(F.col("a.other").alias("x"), F.col("b.other").alias("y")).distinct()
        pairs = pairs.join(vectors.select(F.col("id").alias("x"), F.col("v").cast("array<double>").alias("vx")), "x").join(vectors.select(F.col("id").alias("y"), F.col("v").cast("array<double>").alias("vy")), "y")

        def measure(batches):
            for b in batches:
                if b.num_rows:
                    d = np.sqrt(((matrix(b.column("vx")) - matrix(b.column("vy"))) ** 2).sum(1))
                    x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
                    yield _rows(np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([d, d]))

        more = pairs.mapInArrow(measure, "id long, other long, d double")
        nxt = ws.keep(nearest_of(graph.unionByName(more), k), "neighbours")
        ws.drop(graph)
        graph = nxt
    return graph


def graph_recall(vectors: DataFrame, graph: DataFrame, k: int, every: int = 50, block: int = 256) -> float:
    """Share of the true k nearest that the graph holds, over every id divisible by ``every``, against all vectors (ties count as found)."""
    spark = vectors.sparkSession
    asked = [(r["id"], r["v"]) for r in vectors.where(F.col("id") % every == 0).select("id", "v").orderBy("id").toLocalIterator()]
    hits = total = 0
    for at in range(0, len(asked), block):
        part = asked[at : at + block]
        ids, x = np.array([i for i, _ in part]), np.array([v for _, v in part], dtype=np.float64)

        def nearest(batches, ids=ids, x=x):
            best = np.full((len(ids), k), np.inf)
            for b in batches:
                if b.num_rows:
                    d = distances(x, matrix(b.column("v")))
                    d[ids[:, None] == b.column("id").to_numpy()[None, :]] = np.inf
                    best = np.sort(np.concatenate([best, d], axis=1), axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k), pa.int64()), pa.array(best.ravel())], ["id", "d"])

        true = vectors.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(nearest, "id long, d double").where("d < double('inf')")
        rank = Window.partitionBy("id").orderBy("d")
        true = true.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= k).groupBy("id").agg(F.max("d").alias("far"), F.count("*").alias("m"))
        got = graph.join(F.broadcast(true), "id").groupBy("id", "m").agg(F.count_if(F.col("d") <= F.col("far") * (1 + 1e-9) + 1e-7).alias("h"))
        row = true.join(got.select("id", "h"), "id", "left").agg(F.sum(F.least("h", "m")).alias("h"), F.sum("m").alias("m")).first()
        hits, total = hits + int(row["h"] or 0), total + int(row["m"] or 0)
    return hits / total if total else 1.0
