"""Sums of small arrays over all partitions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 20  # bytes of an array that one task adds up
AT_ONCE = 8 << 20  # bytes of partial sums that the driver adds up itself


def summed(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], shape: tuple[int, ...], dtype: type = np.float64) -> np.ndarray:
    """Sum of one array a partition, which ``work`` makes of the partition's batches.

    The driver gets one array, or partial sums of ``AT_ONCE`` bytes in all. Large ones are made by about as many tasks as
    the cluster runs at a time, and their slices are added up by tasks, each of
    a slice; partial sums of many partitions meet in about as many groups as
    the square root of their number. They are added in a fixed order: the same
    partitions give the same bits.
    """
    itemsize = np.dtype(dtype).itemsize
    size = math.prod(shape) * itemsize
    n = df.rdd.getNumPartitions()
    if size > SLICE:
        n = min(n, max(1, df.sparkSession.sparkContext.defaultParallelism))
        df = df.coalesce(n)

    def run(batches):
        got = work(batches)
        if got is not None:
            flat = np.ascontiguousarray(got, dtype=dtype).reshape(-1)
            for k, at in enumerate(range(0, max(1, flat.size), SLICE // itemsize)):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([k], pa.int64()), pa.array([flat[at : at + SLICE // itemsize].tobytes()], pa.binary())], ["part", "slice", "total"])

    def add(blobs: list[bytes]) -> np.ndarray:
        out = np.frombuffer(blobs[0], dtype=dtype).copy()
        for x in blobs[1:]:
            out += np.frombuffer(x, dtype=dtype)
        return out

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        return pa.table({"part": t.column("part").slice(0, 1), "slice": t.column("slice").slice(0, 1), "total": pa.array([add(t.column("total").to_pylist()).tobytes()], pa.binary())})

    schema = "part long, slice long, total binary"
    parts = df.mapInArrow(run, schema)
    if n > 64:
        parts = parts.groupBy("slice", (F.col("part") % math.isqrt(n)).alias("g")).applyInArrow(lambda _, t: merge(t), schema)
    if size > SLICE and n > 1 and size * n > AT_ONCE:
        parts = parts.groupBy("slice").applyInArrow(lambda _, t: merge(t), schema)
    by: dict[int, list[bytes]] = {}
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        by.setdefault(r["slice"], []).append(bytes(r["total"]))
    if not by:
        return np.zeros(shape, dtype=dtype)
    return np.concatenate([add(by[k]) for k in sorted(by)]).reshape(shape)
