"""Full prefix doubling over all text positions, with Spark sorting the rank pairs.

Every position begins with its first eight bytes as rank. A round joins the
rank at p with the rank at p + k, sorts the pairs over the cluster (range
partitions, so equal pairs meet and a hot pair streams through one sorted
partition without being held), names each pair anew and drops the positions
whose pair is unique. A position whose partner was dropped is unique too, so
the join drops it. Offsets grow 8, 16, 32, ... until the threshold; the last
round orders equal pairs by doc_id and keeps the positions after the least.

The result equals ``suffix_dedup.dedup_suffixes``, which ranks sampled
positions first and so moves far less; this form is what that one is measured
against. Definite results are the same: null text is empty; texts under
``min_len`` bytes keep all; rows with one doc_id are not smaller than one
another; a null doc_id counts as larger than any other; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm.suffix_dedup import OUT
from tessera.runtime import Workspace, parts_for, text_bytes

POSITION = "line long, pos int, doc_id long"


def _first_ranks(table: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    """Each position with its first ``width`` bytes (at most eight) as one number."""
    block = table.column("block")[0].as_py()
    ids, texts = B.unpack_docs(table)
    for k, t in enumerate(texts):
        for x in range(0, len(t) - width + 1, 1 << 18):  # a long text goes out in parts
            buf = np.frombuffer(t, dtype=np.uint8)[x : x + (1 << 18) + width - 1].astype(np.uint64)
            n = len(buf) - width + 1
            rank = np.zeros(n, dtype=np.uint64)
            for j in range(width):
                rank = (rank << np.uint64(8)) | buf[j : j + n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block << 32 | k)), pa.array(np.arange(x, x + n, dtype=np.int32)), pa.array(np.full(n, ids[k])), pa.array(rank.view(np.int64))],
                ["line", "pos", "doc_id", "a"],
            )


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Sorted batches with two marks a row: begins a group, and is alone in it."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        a, c = (np.asarray(b.column(k)) for k in ("a", "b"))
        begin = np.ones(len(a), dtype=bool)
        begin[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        if held is not None:
            old, own, end = held
            begin[0] = (a[0], c[0]) != end
            yield old, own, own & np.append(own[1:], begin[0])
        held = b, begin, (a[-1], c[-1])
    if held is not None:
        old, own, _ = held
        yield old, own, own & np.append(own[1:], True)


def _rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """New ranks of the positions whose pair is not unique: groups numbered in sorted order within the partition."""
    n = (TaskContext.get().partitionId() << 40) - 1
    for b, begin, alone in _heads(batches):
        rank = n + np.cumsum(begin)
        n = int(rank[-1])
        keep = pa.array(~alone)
        yield pa.RecordBatch.from_arrays([b.column("line"), b.column("pos"), b.column("doc_id"), pa.array(rank)], ["line", "pos", "doc_id", "a"]).filter(keep)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions whose string also starts in a smaller doc_id; equal pairs come in doc_id order."""
    least = 0
    for b, begin, _ in _heads(batches):
        ids = np.asarray(b.column("doc_id"))
        group = np.cumsum(begin)
        first = np.concatenate([[least], ids[begin]])[group]
        least = int(first[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column("line")) >> 32), b.column("line"), b.column("pos")], ["block", "line", "pos"]).filter(pa.array(ids > first))


def _cut(docs: pa.Table, hits: pa.Table, min_len: int, with_text: bool) -> pa.Table:
    ids, texts = B.unpack_docs(docs)
    line, pos = np.asarray(hits.column("line")) & 0xFFFFFFFF, np.asarray(hits.column("pos"))
    order = np.lexsort((pos, line))
    line, pos = line[order], pos[order].astype(np.int64)
    out = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept_text")}
    for k, t in enumerate(texts):
        p = pos[slice(*np.searchsorted(line, [k, k + 1]))]
        edge = np.zeros(len(t) + 1, dtype=np.int64)
        np.add.at(edge, p, 1)
        np.add.at(edge, p + min_len, -1)
        gone = np.cumsum(edge[:-1]) > 0
        t = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        out["n_removed"].append(int(np.count_nonzero(gone)))
        out["n_spans"].append(int(np.count_nonzero(np.diff(np.append(0, gone.astype(np.int8))) == 1)))
        out["kept_sha256"].append(hashlib.sha256(t).hexdigest())
        out["kept_text"].append(t if with_text else None)
    return pa.table({"doc_id": B.doc_ids(ids), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept_text": pa.array(out["kept_text"], pa.binary())})


def dedup_by_ranks(docs: DataFrame, *, min_len: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, block_bytes: int = 1 << 20, positions_per_task: int = 4 << 20) -> DataFrame:
    """Remove each byte covered by a ``min_len``-byte string that also starts in a document of smaller doc_id.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept_text (bytes; null unless ``with_text``).
    """
    if min_len < 1:
        raise ValueError("min_len must be positive")
    ws = Workspace(docs.sparkSession)
    total = text_bytes(docs, text_col)
    packed = B.pack_docs(docs, id_col, text_col, parts_for(total, block_bytes))
    n_tasks = parts_for(total, positions_per_task)
    reach = min(8, min_len)

    def first(table: pa.Table) -> pa.Table:
        parts = list(_first_ranks(table, reach))
        return pa.Table.from_batches(parts) if parts else pa.table({"line": pa.array([], pa.int64()), "pos": pa.array([], pa.int32()), "doc_id": pa.array([], pa.int64()), "a": pa.array([], pa.int64())})

    ranks = packed.groupBy("block").applyInArrow(first, f"{POSITION}, a long").withColumn("b", F.lit(0).cast("long"))
    while True:
        pairs = ranks.repartitionByRange(n_tasks, "a", "b")
        if reach == min_len:
            hits = pairs.sortWithinPartitions("a", "b", "doc_id").mapInArrow(B.released(_later), "block long, line long, pos int")
            break
        own = ws.keep(pairs.sortWithinPartitions("a", "b").mapInArrow(B.released(_rerank), f"{POSITION}, a long"), f"ranks{reach}")
        step = min(reach, min_len - reach)
        ranks = own.join(own.select("line", (F.col("pos") - step).alias("pos"), F.col("a").alias("b")), ["line", "pos"])
        reach += step
    hits = ws.keep(hits, "hits")
    return packed.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(lambda d, h: _cut(d, h, min_len, with_text), OUT)
