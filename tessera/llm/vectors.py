"""Vector columns as matrices, and sums of small arrays over all partitions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import released


def usable(vector: Column) -> Column:
    """Whether a vector (array of doubles) is there and all its entries are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def common_length(df: DataFrame, column: str) -> tuple[int, int]:
    """The most frequent length of a vector column (of ties the largest), and how many vectors have it; (0, 0) of none."""
    got = df.groupBy(F.size(column).alias("dim")).agg(F.count("*").alias("n")).where("dim > 0").orderBy(F.desc("n"), F.desc("dim")).first()
    return (int(got["dim"]), int(got["n"])) if got else (0, 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls, all of length ``dim``."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def summed(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], shape: tuple[int, ...], dtype: type = np.float64) -> np.ndarray:
    """Sum of one array a partition, which ``work`` makes of the partition's batches.

    Partial sums of many partitions meet in about as many groups as the square
    root of their number, so neither a group nor the driver gets them all.
    They are added in a fixed order: the same partitions give the same bits.
    """

    def run(batches):
        got = work(batches)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.ascontiguousarray(got, dtype=dtype).tobytes()], pa.binary())], ["part", "total"])

    def add(blobs: list[bytes]) -> np.ndarray:
        out = np.zeros(shape, dtype=dtype)
        for x in blobs:
            out += np.frombuffer(x, dtype=dtype).reshape(shape)
        return out

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        return pa.table({"part": t.column("part").slice(0, 1), "total": pa.array([add(t.column("total").to_pylist()).tobytes()], pa.binary())})

    schema = "part long, total binary"
    parts = df.mapInArrow(released(run), schema)
    n = df.rdd.getNumPartitions()
    if n > 64:
        parts = parts.groupBy((F.col("part") % math.isqrt(n)).alias("g")).applyInArrow(lambda _, t: merge(t), schema)
    rows = sorted(parts.collect(), key=lambda r: r["part"])
    return add([bytes(r["total"]) for r in rows])
