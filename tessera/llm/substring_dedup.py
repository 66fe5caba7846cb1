"""Removal of word windows that occur more than once, by super-k-mers.

The minimiser of a window is the least hash among its m-word sequences.
Consecutive windows that share it form a super-k-mer, which travels as one
packed string to the bucket of its minimiser; equal windows have equal
minimisers, so a bucket sees every occurrence of its windows, and sorting
window fingerprints there counts them exactly. A block of documents sends
each distinct super-k-mer once, with a mark if it holds it several times, so
that a passage of a third of all rows costs a bucket one string a block.

A minimiser may be hot: a phrase in a third of all documents, each time between
other words, would bring all of these strings to one bucket. A first pass
weighs the minimisers; what it finds hot does not travel as strings: each of
its windows goes as a fingerprint to the bucket that the fingerprint names, so
the windows of one minimiser spread over all buckets. Equal windows share their
minimiser, so they always travel alike and still meet.

Definite results: null or empty text has no words; fewer words than a window
are never removed; a null doc_id is an ordinary row; rows with one doc_id are
rows of their own; further input columns are ignored. Fingerprints are 128
bits: two different windows fall together with odds of about n^2 / 2^129.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import blocks as B
from tessera.runtime import parts_for, tasks_for, text_bytes

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _runs(texts: list[bytes], window: int, m: int):
    """Super-k-mers of some documents: word table, first window, windows, minimiser, 128-bit content hash."""
    w = B.Words(texts)
    h = w.hashes(0)
    n = len(h)
    pre = B.prefix(h, 0)
    if n < window:
        return w, *(np.empty(0, np.int64) for _ in range(2)), *(np.empty(0, np.uint64) for _ in range(3))
    low = B.sliding_min(B.windows(pre, m, 0), window - m + 1)  # a value a window
    ok = w.doc[: n - window + 1] == w.doc[window - 1 :]
    begin = ok.copy()
    begin[1:] &= ~(ok[:-1] & (low[1:] == low[:-1]))
    first = np.flatnonzero(begin)
    ends = ok.copy()
    ends[:-1] &= ~(ok[1:] & (low[1:] == low[:-1]))
    count = np.flatnonzero(ends) - first + 1
    last = first + count + window - 1
    return w, first, count, low[first], B.spans(pre, first, last, 0), B.spans(B.prefix(h, 1), first, last, 1)


def _block(table: pa.Table, window: int, m: int):
    """Every run of a block, and its distinct runs by bucket order."""
    ids, texts = B.unpack_docs(table)
    texts = [b" ".join(t.split()) for t in texts]
    parts = []
    for s in B.slices(texts):
        parts.append((s, *_runs(texts[s], window, m)))
    return ids, texts, parts


def _hot_minimisers(docs: DataFrame, text_col: str, window: int, m: int, total: int, limit: int) -> np.ndarray:
    def weigh(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        _, _, count, low, *_ = _runs([b" ".join(t.split()) for t in texts], window, m)
        return low, count

    return B.heavy_keys(docs, text_col, weigh, total, limit)


def _distinct(parts, n_buckets: int, hot: np.ndarray):
    """Distinct runs by bucket: their indices, each run's place among them, buckets, times. Hot ones come last, in bucket ``n_buckets``."""
    low, a, b = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.uint64) for k in (4, 5, 6))
    bucket = np.where(np.isin(low, hot), n_buckets, (B.mix(low) % np.uint64(n_buckets)).astype(np.int64))
    order, begin = B.group_equal(a, b)
    heads = order[begin]
    group = np.cumsum(begin) - 1
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = group
    by_bucket = np.lexsort((heads, bucket[heads]))
    rank = np.empty(len(heads), dtype=np.int64)
    rank[by_bucket] = np.arange(len(heads))
    return heads[by_bucket], rank[inverse], bucket[heads[by_bucket]], np.bincount(rank[inverse], minlength=len(heads))


def _spread(parts, heads: np.ndarray, window: int, n_buckets: int):
    """Fingerprints of all windows of the given runs (in order of their indices), the bucket of each, and the order by bucket."""
    a, b, at = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], 0
    for _, w, first, count, *_ in parts:
        own = heads[slice(*np.searchsorted(heads, [at, at + len(first)]))] - at
        at += len(first)
        if len(own):
            where = B.ragged(first[own], count[own])
            for k, out in ((0, a), (1, b)):
                out.append(B.windows(B.prefix(w.hashes(k), k), window, k)[where])
    a, b = np.concatenate(a), np.concatenate(b)
    bucket = (B.mix(a) % np.uint64(n_buckets)).astype(np.int64)
    return a, b, bucket, np.argsort(bucket, kind="stable")


def _send(table: pa.Table, window: int, m: int, n_buckets: int, hot: np.ndarray) -> pa.Table:
    block = table.column("block")[0].as_py()
    _, _, parts = _block(table, window, m)
    heads, _, bucket, times = _distinct(parts, n_buckets, hot)
    n = int(np.searchsorted(bucket, n_buckets))  # the rest are hot
    all_counts = np.concatenate([p[3] for p in parts]) if parts else np.empty(0, np.int64)
    a, b, to, by = _spread(parts, heads[n:], window, n_buckets)
    a, b, to, twice = a[by], b[by], to[by], np.repeat(times[n:] > 1, all_counts[heads[n:]])[by]
    heads, bucket, times = heads[:n], bucket[:n], times[:n]
    strings: list[bytes] = [b""] * len(heads)
    counts = np.zeros(len(heads), dtype=np.int32)
    at = 0
    where = np.argsort(heads, kind="stable")
    sorted_heads = heads[where]
    for s, w, first, count, *_ in parts:
        lo, hi = np.searchsorted(sorted_heads, [at, at + len(first)])
        local = sorted_heads[lo:hi] - at
        raw = w.buf.tobytes()
        f, c = first[local], count[local]
        begin, end = w.start[f], w.end[f + c + window - 2]
        counts[where[lo:hi]] = c
        for k, x, y in zip(where[lo:hi].tolist(), begin.tolist(), end.tolist(), strict=True):
            strings[k] = raw[x:y]
        at += len(first)
    keys, blobs = np.union1d(bucket, to), []
    edges = (np.searchsorted(x, keys, side=side).tolist() for x in (bucket, to) for side in ("left", "right"))
    for x, y, u, v in zip(*edges, strict=True):
        blobs.append(B.arrays(counts[x:y], (times[x:y] > 1).astype(np.uint8), b"\n".join(strings[x:y]), a[u:v], b[u:v], twice[u:v].astype(np.uint8)))
    return pa.table({"bucket": pa.array(keys, pa.int64()), "block": pa.array([block] * len(keys), pa.int64()), "payload": pa.array(blobs, pa.binary())})


def _count(table: pa.Table, window: int) -> pa.Table:
    """Which windows of each sent run occur more than once anywhere."""
    blocks, bits, sizes = table.column("block").to_pylist(), [], []
    a, b, many = [], [], []
    for blob in table.column("payload").to_pylist():
        counts, twice, raw, hot_a, hot_b, hot_twice = B.unpack(blob, np.int32, np.uint8, None, np.uint64, np.uint64, np.uint8)
        texts, n = raw.split(b"\n") if len(counts) else [], 0
        at = 0
        for s in B.slices(texts):
            w = B.Words(texts[s])
            own = slice(s.start, s.stop)
            at_window = B.ragged(w.first, counts[own].astype(np.int64))
            a.append(B.windows(B.prefix(w.hashes(0), 0), window, 0)[at_window])
            b.append(B.windows(B.prefix(w.hashes(1), 1), window, 1)[at_window])
            many.append(np.repeat(twice[own], counts[own]))
            n += len(at_window)
            at = s.stop
        assert at == len(counts), "a run was lost"
        a.append(hot_a)
        b.append(hot_b)
        many.append(hot_twice)
        sizes.append(n + len(hot_a))
    a, b, many = np.concatenate(a), np.concatenate(b), np.concatenate(many)
    order, begin = B.group_equal(a, b)
    group = np.cumsum(begin) - 1
    repeated = np.empty(len(a), dtype=bool)
    repeated[order] = (np.bincount(group) > 1)[group]
    repeated |= many.astype(bool)
    at = 0
    for n in sizes:
        bits.append(B.arrays(np.array([n], dtype=np.int64), np.packbits(repeated[at : at + n])))
        at += n
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": table.column("bucket").combine_chunks(), "payload": pa.array(bits, pa.binary())})


def _finish(docs: pa.Table, marks: pa.Table, window: int, m: int, n_buckets: int, hot: np.ndarray, with_text: bool) -> pa.Table:
    ids, texts, parts = _block(docs, window, m)
    heads, rank, bucket, _ = _distinct(parts, n_buckets, hot)
    all_counts = np.concatenate([p[3] for p in parts]) if parts else np.empty(0, np.int64)
    head_counts = all_counts[heads]
    got = sorted(zip(marks.column("bucket").to_pylist(), marks.column("payload").to_pylist(), strict=True))
    own = np.bincount(bucket, weights=head_counts, minlength=n_buckets + 1).astype(np.int64)  # windows that went as strings
    _, _, _, by = _spread(parts, heads[bucket == n_buckets], window, n_buckets)
    flags, spread = [np.empty(0, np.uint8)], [np.empty(0, np.uint8)]
    for k, blob in got:
        n, raw = B.unpack(blob, np.int64, np.uint8)
        bits = np.unpackbits(raw, count=int(n[0]))
        flags.append(bits[: own[k]])
        spread.append(bits[own[k] :])
    spread = np.concatenate(spread)
    if len(spread) != len(by):
        raise ValueError("answers do not fit the block's hot windows")
    flags.append(np.empty(len(by), np.uint8))
    flags[-1][by] = spread
    flag = np.concatenate(flags).astype(bool)
    if len(flag) != int(head_counts.sum()):
        raise ValueError("answers do not fit the block's runs")
    head_at = np.cumsum(head_counts) - head_counts
    out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept_text")}
    at = 0
    for s, w, first, count, *_ in parts:
        mine = rank[at : at + len(first)]
        at += len(first)
        starts = B.ragged(first, count)[flag[B.ragged(head_at[mine], count)]]
        edge = np.zeros(len(w.start) + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.add.reduceat(np.append(gone, False), w.first)[: len(w.count)] * (w.count > 0) if len(w.count) else w.count
        for k, t in enumerate(texts[s]):
            n, r = int(w.count[k]), int(removed[k])
            if r:
                keep = ~gone[w.first[k] : w.first[k] + n]
                words = t.split(b" ")
                t = b" ".join([words[j] for j in np.flatnonzero(keep).tolist()])
            out["n_words"].append(n)
            out["n_removed"].append(r)
            out["kept_sha256"].append(hashlib.sha256(t).hexdigest())
            out["kept_text"].append(t.decode() if with_text else None)
    return pa.table({"doc_id": B.doc_ids(ids), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept_text": pa.array(out["kept_text"], pa.string())})


def dedup_windows(docs: DataFrame, *, window: int = 35, m: int = 8, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, block_bytes: int = 8 << 20, hot_windows: int = 2_000_000) -> DataFrame:
    """Remove words covered by a ``window``-word sequence that starts anywhere else too.

    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256,
    kept_text (null unless ``with_text``). A minimiser of ``hot_windows``
    windows or more is spread over all buckets.
    """
    m = min(m, window)
    total = text_bytes(docs, text_col)
    n_blocks = parts_for(total, block_bytes)
    n_buckets = 2 * n_blocks
    # a text of n bytes has fewer than n / 2 windows, so at most 2^23 minimisers are hot (64 MB), and these only at 100 TB or so
    hot = docs.sparkSession.sparkContext.broadcast(_hot_minimisers(docs, text_col, window, m, total, max(hot_windows, total >> 24)))
    packed = B.pack_docs(docs, id_col, text_col, n_blocks)
    sent = packed.groupBy("block").applyInArrow(lambda t: _send(t, window, m, n_buckets, hot.value), "bucket long, block long, payload binary")
    # partitions follow the data, not the session's setting
    sent = sent.repartition(tasks_for(total), "bucket")
    marks = sent.groupBy("bucket").applyInArrow(lambda t: _count(t, window), "block long, bucket long, payload binary")
    return packed.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda d, r: _finish(d, r, window, m, n_buckets, hot.value, with_text), OUT)
