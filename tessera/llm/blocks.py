"""Blocks of documents, and hashes of words and windows, in numpy.

A block is a group of documents dealt by a hash of doc_id, so that neither a
source nor a group of copies decides its size. It travels as a few compressed
rows, is rebuilt identically wherever it is needed (documents in doc_id
order), and is the unit in which repeated work is pre-aggregated.
"""

from __future__ import annotations

import ctypes
import struct
import sys
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL_ID = np.iinfo(np.int64).max  # stands for a null doc_id; sorts after all others
U64 = np.uint64


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.int64).view(U64) * U64(2) + U64(1)


BASE = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]  # odd multipliers, one for each of two independent hashes
TABLE = [_odd(7 + k, 256) for k in range(2)]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(k: int, n: int, inverse: bool = False) -> np.ndarray:
    """1, B, B^2 ... modulo 2^64 (or of the inverse of B), n of them at least."""
    have = _POWERS.get((k, inverse))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        b = BASE[k] if not inverse else pow(BASE[k], -1, 1 << 64)
        p = np.full(size, b, dtype=U64)
        p[0] = 1
        have = _POWERS[(k, inverse)] = np.multiply.accumulate(p)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all 64 bits."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0x9FB21C651E98DF25)
    return h ^ (h >> U64(32))


def prefix(values: np.ndarray, k: int) -> np.ndarray:
    """Prefix sums of values times powers, with a leading zero."""
    out = np.empty(len(values) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(values * powers(k, len(values))[: len(values)], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Hash of each [start, end) out of prefix sums; equal contents hash alike."""
    return mix((pre[end] - pre[start]) * powers(k, len(pre), True)[start])


def windows(pre: np.ndarray, width: int, k: int) -> np.ndarray:
    """Hash of every window of ``width`` values."""
    n = max(0, len(pre) - width)
    return mix((pre[width:] - pre[:n]) * powers(k, len(pre), True)[:n])


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have, m = 1, h
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1 ... of every run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of documents whose white space is already single spaces."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        cut = np.flatnonzero(SPACE[self.buf])
        start = np.concatenate([[0], cut[:-1] + 1])
        full = start < cut  # an empty text is no word
        doc = np.zeros(len(cut), dtype=np.int64)
        doc[1:] = np.cumsum(self.buf[cut] == 10)[:-1]
        self.start, self.end, self.doc = start[full], cut[full], doc[full]
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64) if len(texts) else np.empty(0, np.int64)

    def hashes(self, k: int) -> np.ndarray:
        return spans(prefix(TABLE[k][self.buf], k), self.start, self.end, k)


def arrays(*parts: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed string."""
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    head = struct.pack(f"<{len(raw) + 1}q", len(raw), *map(len, raw))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(raw))


def unpack(blob: bytes, *types) -> list:
    """What ``arrays`` packed; a type of None gives bytes."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    sizes = struct.unpack_from(f"<{n}q", raw, 8)
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes, types, strict=True):
        out.append(raw[at : at + size] if kind is None else np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def by_bytes(batch: pa.RecordBatch | pa.Table, column: int | str, most: int = 1 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Parts of a batch that hold about ``most`` bytes of a string or binary column; a longer row is alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # a C library without it
        return lambda _: 0


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and others need the room."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(run):
    """``run`` over batches, with freed memory given back once the partition ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def block_of(ids: np.ndarray, n_blocks: int) -> np.ndarray:
    return (mix(ids.view(U64) * U64(BASE[0]) + U64(0x1234567)) % U64(n_blocks)).astype(np.int64)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False), dtype=np.int64)


def pack_docs(docs: DataFrame, id_col: str, text_col: str, n_blocks: int) -> DataFrame:
    """(block, payload): the documents of a batch that fall in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = ids_of(b.column(0)), texts_of(b.column(1))
            where = block_of(ids, n_blocks)
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            keys, blobs = [], []
            for part in np.split(order, cuts) if len(order) else []:
                own = [texts[i] for i in part]
                keys.append(int(where[part[0]]))
                blobs.append(arrays(ids[part], np.array([len(x) for x in own], dtype=np.int64), b"".join(own)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["block", "payload"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "block long, payload binary")


WEIGHED = 64 << 20  # bytes of text that a task weighs before it reports


def heavy_keys(docs: DataFrame, text_col: str, weigh: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], total: int, limit: int) -> np.ndarray:
    """Keys (unsigned, sorted) of weight ``limit`` or more; all of twice as much are found.

    ``weigh`` gives keys and weights of some texts. Each part of a task's texts
    reports the keys that hold more than the part's share of ``limit``: so one
    goes without less than ``limit`` in all, and the driver gets no more keys
    than the whole weight divided by ``limit``.
    """

    def report(size: int, keys: list[np.ndarray], weights: list[np.ndarray]) -> pa.RecordBatch:
        values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.bincount(inverse, weights=np.concatenate(weights), minlength=len(values)).astype(np.int64)
        keep = weight > limit * (size / max(1, total))
        return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(weight[keep])], ["key", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, keys, weights = 0, [], []
        for part in (part for whole in batches for part in by_bytes(whole, 0)):
            texts = texts_of(part.column(0))
            k, w = weigh(texts)
            size += sum(map(len, texts))
            keys.append(k)
            weights.append(w)
            if size >= WEIGHED:
                yield report(size, keys, weights)
                size, keys, weights = 0, [], []
        if keys:
            yield report(size, keys, weights)

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(released(run), "key long, weight long")
    found = found.groupBy("key").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= limit)
    return np.sort(np.array([r["key"] for r in found.select("key").collect()], dtype=np.int64).view(U64))


def unpack_docs(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """The documents of one block in doc_id order (ties: by text)."""
    ids, texts = [], []
    for blob in table.column("payload").to_pylist():
        i, n, raw = unpack(blob, np.int64, np.int64, None)
        ends = np.cumsum(n)
        ids.append(i)
        texts += [raw[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
    if not texts:
        return np.empty(0, np.int64), []
    all_ids = np.concatenate(ids)
    order = sorted(range(len(texts)), key=lambda j: (all_ids[j], texts[j]))
    return all_ids[order], [texts[j] for j in order]


def slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[slice]:
    """Runs of documents of about ``most`` bytes; a longer document is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def group_equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal (a, b) together, and which positions begin a group."""
    order = np.argsort(a, kind="stable")
    sa, sb = a[order], b[order]
    same = sa[1:] == sa[:-1]
    if np.any(same & (sb[1:] != sb[:-1])):  # two contents with one first hash
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        same = (sa[1:] == sa[:-1]) & (sb[1:] == sb[:-1])
    begin = np.ones(len(a), dtype=bool)
    begin[1:] = ~same
    return order, begin


def doc_ids(ids: np.ndarray) -> pa.Array:
    """doc_id for output, with nulls back in place."""
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


assert sys.byteorder == "little", "packed arrays are little-endian"
