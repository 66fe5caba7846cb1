"""Removal of byte strings repeated from earlier documents, by prefix doubling.

Ranks are names of strings that start at a text position. Round one ranks
strings of half the threshold, at the positions that matter: every window of
``min_len`` bytes holds a sampled half-length string, its least by hash, so
ranking the samples and dropping those that are unique drops exactly the
windows that cannot repeat. Round two doubles: at the surviving positions p
the pair (rank at p, rank at p + half) is sorted, which ranks strings of
``min_len`` bytes, and each rank learns the smallest doc_id in it. Past the
threshold nothing further is needed. Ranks are content fingerprints (128 bits
in round two), so each round is one exchange, not a sort of all positions.

Blocks of documents send each distinct string once, with the smallest doc_id
that has it there; a passage of a third of all rows is one string a block. A
sampled string may be hot: a phrase of a third of all documents, each time
between other bytes. A first pass weighs the samples; windows of hot ones travel
as rank pairs, each to the bucket that its pair names, not as strings to one
bucket. Equal windows have equal samples, so they travel alike and still meet.

Definite results: null text is empty; texts under ``min_len`` bytes keep all;
rows with one doc_id are not smaller than one another; a null doc_id counts
as larger than any other; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.runtime import Workspace, parts_for, tasks_for, text_bytes

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"
SHORT = np.uint64(0xFFFFFFFFFF)  # round one sends 40 bits of a rank; a clash only keeps a string for round two


def _pair(pre: np.ndarray, where: np.ndarray, min_len: int, k: int) -> np.ndarray:
    """The rank of round one at each place, and half a threshold on, as one number."""
    half = -(-min_len // 2)
    r = B.windows(pre, half, k)
    return B.mix(r[where] * np.uint64(B.BASE[0]) + r[where + min_len - half])  # equal to half if the length is even


class _Runs:
    """Runs of consecutive windows with one sampled string, over a slice of a block."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], min_len: int):
        half = -(-min_len // 2)
        self.min_len, self.half = min_len, half
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.raw = b"".join(texts)
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        n = len(self.buf)
        if n < min_len:
            self.first = self.count = self.doc = np.empty(0, np.int64)
            self.low = np.empty(0, np.uint64)
            return
        self.pre = B.prefix(B.TABLE[0][self.buf], 0)
        low = B.sliding_min(B.windows(self.pre, half, 0), min_len - half + 1)
        doc = np.repeat(np.arange(len(texts)), self.size)
        ok = doc[: n - min_len + 1] == doc[min_len - 1 :]
        joined = ok[1:] & ok[:-1] & (low[1:] == low[:-1])
        joined &= doc[1 : len(ok)] == doc[: len(ok) - 1]
        begin = ok.copy()
        begin[1:] &= ~joined
        end = ok.copy()
        end[:-1] &= ~joined
        self.first = np.flatnonzero(begin)
        self.count = np.flatnonzero(end) - self.first + 1
        self.low = low[self.first]
        self.doc = doc[self.first]

    def pairs(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the rank pair at each position."""
        return tuple(_pair(B.prefix(B.TABLE[k][self.buf], k), where, self.min_len, k) for k in range(2))

    def names(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit content hash of the chosen runs."""
        if not len(keep):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        f, e = self.first[keep], self.first[keep] + self.count[keep] + self.min_len - 1
        return B.spans(self.pre, f, e, 0), B.spans(B.prefix(B.TABLE[1][self.buf], 1), f, e, 1)


def _load(table: pa.Table, min_len: int):
    ids, texts = B.unpack_docs(table)
    parts = [(s, _Runs(ids[s], texts[s], min_len)) for s in B.slices(texts)]
    return ids, texts, parts


def _buckets(low: np.ndarray, n_buckets: int) -> np.ndarray:
    return (B.mix(low) % np.uint64(n_buckets)).astype(np.int64)


def _cuts(keys: np.ndarray) -> list[tuple[int, int]]:
    if not len(keys):
        return []
    edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _ranks_in(parts, n_buckets: int):
    """Distinct sampled ranks of a block, by bucket: (bucket, rank, in several documents), and where each run's is."""
    low = np.concatenate([p.low for _, p in parts]) if parts else np.empty(0, np.uint64)
    doc = np.concatenate([p.doc + s.start for s, p in parts]) if parts else np.empty(0, np.int64)
    values, inverse = np.unique(low, return_inverse=True)
    least = np.full(len(values), np.iinfo(np.int64).max)
    most = np.full(len(values), -1)
    np.minimum.at(least, inverse, doc)
    np.maximum.at(most, inverse, doc)
    bucket = _buckets(values, n_buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return bucket[order], values[order], (least < most)[order], place[inverse]


def _send_ranks(table: pa.Table, min_len: int, n_buckets: int) -> pa.Table:
    block = table.column("block")[0].as_py()
    _, _, parts = _load(table, min_len)
    bucket, values, several, _ = _ranks_in(parts, n_buckets)
    keys, blobs = [], []
    for x, y in _cuts(bucket):
        v = (values[x:y] & SHORT).view(np.uint8).reshape(-1, 8)[:, :5]
        keys.append(int(bucket[x]))
        blobs.append(B.arrays(v, np.packbits(several[x:y])))
    return pa.table({"bucket": pa.array(keys, pa.int64()), "block": pa.array([block] * len(keys), pa.int64()), "payload": pa.array(blobs, pa.binary())})


def _unique_ranks(table: pa.Table) -> pa.Table:
    """A bit for each rank sent: set if it occurs in several documents."""
    values, several, sizes = [], [], []
    for blob in table.column("payload").to_pylist():
        v, s = B.unpack(blob, np.uint8, np.uint8)
        wide = np.zeros((len(v) // 5, 8), dtype=np.uint8)
        wide[:, :5] = v.reshape(-1, 5)
        values.append(wide.reshape(-1).view(np.uint64))
        sizes.append(len(wide))
        several.append(np.unpackbits(s, count=len(wide)).astype(bool))
    v = np.concatenate(values)
    order = np.argsort(v, kind="stable")
    same = v[order][1:] == v[order][:-1]
    hit = np.zeros(len(v), dtype=bool)
    hit[1:] |= same
    hit[:-1] |= same
    keep = np.empty(len(v), dtype=bool)
    keep[order] = hit
    keep |= np.concatenate(several)
    ends = np.cumsum(sizes)
    bits = [B.arrays(np.array([n], dtype=np.int64), np.packbits(keep[e - n : e])) for e, n in zip(ends.tolist(), sizes, strict=True)]
    return pa.table({"block": table.column("block").combine_chunks(), "bucket": table.column("bucket").combine_chunks(), "payload": pa.array(bits, pa.binary())})


def _survivors(parts, marks: list[tuple[int, bytes]], n_buckets: int, hot: np.ndarray):
    """Runs whose sampled string repeats, and the distinct ones by bucket; hot ones come last, in bucket ``n_buckets``."""
    _, _, _, place = _ranks_in(parts, n_buckets)
    bits = []
    for _, blob in sorted(marks):
        n, raw = B.unpack(blob, np.int64, np.uint8)
        bits.append(np.unpackbits(raw, count=int(n[0])).astype(bool))
    bits = np.concatenate(bits) if bits else np.empty(0, bool)
    keep = bits[place] if len(place) else np.empty(0, bool)
    at, chosen, a, b, low, doc = 0, [], [], [], [], []
    for s, p in parts:
        own = np.flatnonzero(keep[at : at + len(p.first)])
        at += len(p.first)
        chosen.append(own)
        x, y = p.names(own)
        a.append(x)
        b.append(y)
        low.append(p.low[own])
        doc.append(p.doc[own] + s.start)
    a, b, low, doc = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((a, np.uint64), (b, np.uint64), (low, np.uint64), (doc, np.int64)))
    order, begin = B.group_equal(a, b)
    heads = order[begin]  # stable sort: the run in the smallest doc_id comes first
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = np.cumsum(begin) - 1
    bucket = np.where(np.isin(low[heads], hot), n_buckets, _buckets(low[heads], n_buckets))
    by = np.lexsort((heads, bucket))
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.arange(len(by))
    return chosen, heads[by], rank[inverse] if len(heads) else inverse, bucket[by], doc


def _spread(parts, chosen: list[np.ndarray], heads: np.ndarray, n_buckets: int):
    """Rank pairs of all windows of the given runs (in order of their indices), the bucket of each, and the order by bucket."""
    a, b, at = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], 0
    for (_, p), own in zip(parts, chosen, strict=True):
        mine = own[heads[slice(*np.searchsorted(heads, [at, at + len(own)]))] - at]
        at += len(own)
        if len(mine):
            x, y = p.pairs(B.ragged(p.first[mine], p.count[mine]))
            a.append(x)
            b.append(y)
    a, b = np.concatenate(a), np.concatenate(b)
    bucket = _buckets(a, n_buckets)
    return a, b, bucket, np.argsort(bucket, kind="stable")


def _send_strings(docs: pa.Table, marks: pa.Table, min_len: int, n_buckets: int, hot: np.ndarray) -> pa.Table:
    empty = pa.table({"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "payload": pa.array([], pa.binary())})
    if not docs.num_rows:
        return empty
    block = docs.column("block")[0].as_py()
    ids, _, parts = _load(docs, min_len)
    chosen, heads, _, bucket, doc = _survivors(parts, list(zip(marks.column("bucket").to_pylist(), marks.column("payload").to_pylist(), strict=True)), n_buckets, hot)
    n = int(np.searchsorted(bucket, n_buckets))  # the rest are hot
    a, b, to, order = _spread(parts, chosen, heads[n:], n_buckets)
    counts = np.concatenate([p.count[own] for (_, p), own in zip(parts, chosen, strict=True)])
    a, b, to, owner = a[order], b[order], to[order], np.repeat(ids[doc[heads[n:]]], counts[heads[n:]])[order]
    heads, bucket = heads[:n], bucket[:n]
    strings: list[bytes] = [b""] * len(heads)
    by = np.argsort(heads, kind="stable")
    at = 0
    for (_, p), own in zip(parts, chosen, strict=True):
        lo, hi = np.searchsorted(heads[by], [at, at + len(own)])
        mine = own[heads[by[lo:hi]] - at]
        at += len(own)
        f, e = p.first[mine], p.first[mine] + p.count[mine] + min_len - 1
        for k, x, y in zip(by[lo:hi].tolist(), f.tolist(), e.tolist(), strict=True):
            strings[k] = p.raw[x:y]
    keys, blobs = np.union1d(bucket, to), []
    edges = (np.searchsorted(k, keys, side=side).tolist() for k in (bucket, to) for side in ("left", "right"))
    for x, y, u, v in zip(*edges, strict=True):
        own = strings[x:y]
        blobs.append(B.arrays(ids[doc[heads[x:y]]], np.array([len(t) for t in own], dtype=np.int32), b"".join(own), a[u:v], b[u:v], owner[u:v]))
    return pa.table({"bucket": pa.array(keys, pa.int64()), "block": pa.array([block] * len(keys), pa.int64()), "payload": pa.array(blobs, pa.binary())})


def _double(table: pa.Table, min_len: int) -> pa.Table:
    """Sort rank pairs of the surviving positions; answer the smallest doc_id of each string of min_len bytes."""
    a, b, owner, sizes = [], [], [], []
    for blob in table.column("payload").to_pylist():
        ids, n, raw, hot_a, hot_b, hot_owner = B.unpack(blob, np.int64, np.int32, None, np.uint64, np.uint64, np.int64)
        buf, n = np.frombuffer(raw, dtype=np.uint8), n.astype(np.int64)
        begin = np.cumsum(n) - n
        total = 0
        at = 0
        while at < len(n):  # pieces of about a megabyte
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + (1 << 20))))
            piece = buf[begin[at] : begin[to - 1] + n[to - 1]]
            count = n[at:to] - min_len + 1
            where = B.ragged(begin[at:to] - begin[at], count)
            for k, to_list in ((0, a), (1, b)):
                to_list.append(_pair(B.prefix(B.TABLE[k][piece], k), where, min_len, k))
            owner.append(np.repeat(ids[at:to], count))
            total += len(where)
            at = to
        a.append(hot_a)
        b.append(hot_b)
        owner.append(hot_owner)
        sizes.append(total + len(hot_a))
    a, b, owner = np.concatenate(a), np.concatenate(b), np.concatenate(owner)
    order, begin = B.group_equal(a, b)
    starts = np.flatnonzero(begin)
    least = np.minimum.reduceat(owner[order], starts)
    answer = np.empty(len(owner), dtype=np.int64)
    answer[order] = np.repeat(least, np.diff(np.append(starts, len(owner))))
    ends = np.cumsum(sizes)
    blobs = [B.arrays(answer[e - n : e]) for e, n in zip(ends.tolist(), sizes, strict=True)]
    return pa.table({"block": table.column("block").combine_chunks(), "bucket": table.column("bucket").combine_chunks(), "payload": pa.array(blobs, pa.binary())})


def _finish(docs: pa.Table, answers: pa.Table, min_len: int, n_buckets: int, hot: np.ndarray, with_text: bool) -> pa.Table:
    ids, texts, parts = _load(docs, min_len)
    got = list(zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True))
    chosen, heads, rank, bucket, _ = _survivors(parts, [(k, p) for kind, k, p in got if kind == 0], n_buckets, hot)
    counts = np.concatenate([p.count[own] for (_, p), own in zip(parts, chosen, strict=True)]) if parts else np.empty(0, np.int64)
    head_counts = counts[heads]
    strings = np.bincount(bucket, weights=head_counts, minlength=n_buckets + 1).astype(np.int64)  # windows that went as strings
    _, _, _, order = _spread(parts, chosen, heads[bucket == n_buckets], n_buckets)
    least, spread = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k, blob in sorted((k, p) for kind, k, p in got if kind == 1):
        answer = B.unpack(blob, np.int64)[0]
        least.append(answer[: strings[k]])
        spread.append(answer[strings[k] :])
    spread = np.concatenate(spread)
    if len(spread) != len(order):
        raise ValueError("answers do not fit the block's hot windows")
    least.append(np.empty(len(order), np.int64))
    least[-1][order] = spread
    least = np.concatenate(least)
    if len(least) != int(head_counts.sum()):
        raise ValueError("answers do not fit the block's strings")
    head_at = np.cumsum(head_counts) - head_counts
    out = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept_text")}
    at = 0
    for (s, p), own in zip(parts, chosen, strict=True):
        mine = rank[at : at + len(own)]
        at += len(own)
        count = p.count[own]
        starts = B.ragged(p.first[own], count)
        owner = np.repeat(ids[p.doc[own] + s.start], count)
        starts = starts[least[B.ragged(head_at[mine], count)] < owner]
        edge = np.zeros(len(p.buf) + 1, dtype=np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + min_len, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for k, t in enumerate(texts[s]):
            x = int(p.begin[k])
            g = gone[x : x + len(t)]
            n = int(np.count_nonzero(g))
            n_spans = 0
            if n:
                n_spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1]))
                t = np.frombuffer(t, dtype=np.uint8)[~g].tobytes()
            out["n_removed"].append(n)
            out["n_spans"].append(n_spans)
            out["kept_sha256"].append(hashlib.sha256(t).hexdigest())
            out["kept_text"].append(t if with_text else None)
    return pa.table({"doc_id": B.doc_ids(ids), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept_text": pa.array(out["kept_text"], pa.binary())})


def _hot_samples(docs: DataFrame, text_col: str, min_len: int, total: int, limit: int) -> np.ndarray:
    def weigh(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        runs = _Runs(np.empty(0, np.int64), texts, min_len)
        return runs.low, runs.count

    return B.heavy_keys(docs, text_col, weigh, total, limit)


def dedup_suffixes(docs: DataFrame, *, min_len: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, block_bytes: int = 8 << 20, hot_windows: int = 4_000_000) -> DataFrame:
    """Remove each byte covered by a ``min_len``-byte string that also starts in a document of smaller doc_id.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept_text (bytes; null unless ``with_text``). A sampled string
    of ``hot_windows`` windows or more is spread over all buckets.
    """
    if min_len < 4:
        raise ValueError("min_len must be 4 or more")
    ws = Workspace(docs.sparkSession)
    total = text_bytes(docs, text_col)
    n_blocks = parts_for(total, block_bytes)
    n_buckets, n_tasks = 2 * n_blocks, tasks_for(total)
    # fewer windows than bytes, so at most 2^23 samples are hot (64 MB), and these only at 30 TB or more
    hot = docs.sparkSession.sparkContext.broadcast(_hot_samples(docs, text_col, min_len, total, max(hot_windows, total >> 23)))
    packed = B.pack_docs(docs, id_col, text_col, n_blocks)
    shape = "block long, bucket long, payload binary"
    ranks = packed.groupBy("block").applyInArrow(lambda t: _send_ranks(t, min_len, n_buckets), "bucket long, block long, payload binary")
    ranks = ranks.repartition(n_tasks, "bucket")  # partitions follow the data, not the session's setting
    marks = ws.keep(ranks.groupBy("bucket").applyInArrow(_unique_ranks, shape), "marks")
    strings = packed.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda d, r: _send_strings(d, r, min_len, n_buckets, hot.value), "bucket long, block long, payload binary")
    strings = strings.repartition(n_tasks, "bucket")
    least = ws.keep(strings.groupBy("bucket").applyInArrow(lambda t: _double(t, min_len), shape), "least")
    answers = marks.withColumn("kind", F.lit(0)).union(least.withColumn("kind", F.lit(1)))
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda d, r: _finish(d, r, min_len, n_buckets, hot.value, with_text), OUT)
