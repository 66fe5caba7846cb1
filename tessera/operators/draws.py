"""Poisson bootstrap draws from a hash: every unit's weight in every replicate, and weighted sums of counts.

A weight depends on the first 32 bits of the SHA-1 of ``seed|replicate|unit``
alone, so draws are the same on any cluster and in SQL. Tasks hash arrays of
units and replicates together and add up counts by a matrix product: one row a
replicate leaves a task, however many units it holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES = 4096  # hashes made together
DRAWS = 8  # the largest weight


def cumulative(draws: int = DRAWS) -> list[float]:
    """Chances of a Poisson(1) count of at most 0, 1, ..."""
    out, term, total = [], 0.36787944117144233, 0.0
    for k in range(draws):
        total += term
        out.append(total)
        term /= k + 1
    return out


def _turned(x: np.ndarray, n: int, spare: np.ndarray) -> None:
    np.left_shift(x, n, out=spare)
    np.right_shift(x, 32 - n, out=x)
    np.bitwise_or(x, spare, out=x)


def sha1_heads(words: list[np.ndarray]) -> np.ndarray:
    """First 32 bits of the SHA-1 of messages of one block: 16 arrays of uint32, which are overwritten."""
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)
    a, b, c, d, e = (np.full(words[0].shape, x, np.uint32) for x in start)
    t, u = np.empty_like(a), np.empty_like(a)
    for i in range(80):
        x = words[i % 16]
        if i >= 16:
            for back in (3, 8, 14):
                np.bitwise_xor(x, words[(i - back) % 16], out=x)
            _turned(x, 1, u)
        if i < 20:
            np.bitwise_and(np.bitwise_xor(c, d, out=t), b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif 40 <= i < 60:
            np.bitwise_and(np.bitwise_or(b, c, out=t), d, out=t)
            np.bitwise_or(t, np.bitwise_and(b, c, out=u), out=t)
        else:
            np.bitwise_xor(np.bitwise_xor(b, c, out=t), d, out=t)
        np.add(e, np.uint32((0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6)[i // 20]), out=e)
        np.add(np.add(e, x, out=e), t, out=e)
        np.add(e, np.left_shift(a, 5, out=t), out=e)
        np.add(e, np.right_shift(a, 27, out=t), out=e)
        _turned(b, 30, u)
        a, b, c, d, e = e, a, b, c, d
    return a + np.uint32(start[0])


def _words(texts: list[bytes], before: int) -> np.ndarray:
    """16 x n words of a block that holds each text from byte ``before`` on, with its end mark and length."""
    block = np.zeros((len(texts), 64), np.uint8)
    for row, t in zip(block, texts, strict=True):
        row[before : before + len(t) + 1] = np.frombuffer(t + b"\x80", np.uint8)
    block[:, 62:] = np.array([(before + len(t)) * 8 for t in texts], ">u2").view(np.uint8).reshape(-1, 2)
    return np.ascontiguousarray(block.view(">u4").astype(np.uint32).T)


def heads(seed: int, replicates: np.ndarray, tails: list[bytes]) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """(replicates, slice of tails, their hashes): first 32 bits of the SHA-1 of ``seed|replicate`` and tail."""
    names = {len(str(r)): [] for r in replicates.tolist()}
    for r in replicates.tolist():
        names[len(str(r))].append(r)
    for own in names.values():  # replicates of one length
        first = [f"{seed}|{r}".encode() for r in own]
        at = len(first[0])
        for i in range(0, len(tails), LANES):
            part = tails[i : i + LANES]
            short = at + max(map(len, part)) <= 55
            if short:
                lead = np.zeros((len(own), 64), np.uint8)
                lead[:, :at] = np.frombuffer(b"".join(first), np.uint8).reshape(-1, at)
                lead, tail = lead.view(">u4").astype(np.uint32).T, _words(part, at)
            step = max(1, LANES // len(part))
            for j in range(0, len(own), step):
                if short:
                    h = sha1_heads([(lead[k, j : j + step, None] | tail[k][None, :]) for k in range(16)])
                else:  # longer than one block
                    h = np.array([[int.from_bytes(hashlib.sha1(p + t).digest()[:4], "big") for t in part] for p in first[j : j + step]], np.uint32)
                yield np.array(own[j : j + step]), slice(i, i + len(part)), h


def drawn_sums(per: DataFrame, unit: str, names: list[str], replicates: int, seed: int) -> DataFrame:
    """(replicate, names): sums of the counts ``names`` of ``per``, a row a unit, each times its weight in the replicate."""
    # u / 2^32 < c exactly where u < ceil(c 2^32)
    cuts = [np.uint32(math.ceil(c * (1 << 32))) for c in cumulative()]
    tasks = 2 * per.sparkSession.sparkContext.defaultParallelism  # the counts are few bytes, the draws much work: not as many tasks as bytes ask for

    def run(batches):
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            if total is None:
                total = np.zeros((replicates, len(names)), np.int64)
            counts = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names], axis=1)
            for rs, at, h in heads(seed, np.arange(replicates), [t.encode() for t in b.column("tail").to_pylist()]):
                w = np.zeros(h.shape, np.uint8)
                for c in cuts:
                    w += h >= c
                total[rs] += (w.astype(np.float64) @ counts[at]).astype(np.int64)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates), pa.int32()), *[pa.array(total[:, k]) for k in range(len(names))]], ["replicate", *names])

    tail = F.concat_ws("|", F.lit(""), F.col(unit).cast("string")).alias("tail")
    each = per.select(tail, *names).repartition(tasks, "tail").mapInArrow(run, "replicate int, " + ", ".join(f"`{c}` long" for c in names))
    return each.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names])
