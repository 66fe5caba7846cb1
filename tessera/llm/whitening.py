"""Whitening of embeddings by matrix-free block Lanczos.

The covariance is never formed: a pass over the rows gives V·Q for a block of
directions Q, as the sum over rows z of z(zᵀQ), centred before multiplying.
The block Krylov basis is fully reorthogonalised against all that came before
(twice), directions that break down are replaced by random ones orthogonal to
the basis (a restart), and passes go on until the residuals ‖Vy - ey‖ of the
wanted pairs, taken from the stored products, are at rounding, or the basis
spans the space. The driver holds a basis of at most dim x dim numbers.

Entries are integers, x = floor(scale * c) + shift, so sums, deviations and
centring are exact: with S = n*q + r, z = (x - q) - r/n. The trace comes from
the deviations, and so do the explained shares.

Definite results: a vector that is null or holds null, NaN or infinite entries
is dropped, and so is one whose length is not the most frequent length (of
ties the largest); x saturates at plus or minus 2^52; rows that repeat, or
without an id, are rows of their own; ``deviation`` is null where it exceeds a
long (the trace stays exact); components without variance have
``whitened`` null and ``explained`` 0, and do not count for ``identity_error``
(0 if there is no other); an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import released
from tessera.llm.vectors import common_length, matrix, summed, usable

LIMIT = 1 << 52
LOW = (1 << 20) - 1
SLICE = 4096  # rows that are centred at a time


def integers(c: np.ndarray, scale: int, shift: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * float(scale)), -LIMIT, LIMIT).astype(np.int64) + shift


@dataclass(frozen=True)
class Fit:
    """Count and sums of the integer rows; S = n*q + r in every dimension."""

    n: int
    q: np.ndarray
    r: np.ndarray
    scale: int
    shift: int

    def off(self, c: np.ndarray) -> np.ndarray:
        """x - q, exact."""
        return integers(c, self.scale, self.shift) - self.q

    def centred(self, c: np.ndarray) -> np.ndarray:
        return self.off(c).astype(np.float64) - self.r / self.n

    def deviations(self, c: np.ndarray) -> list[int] | np.ndarray:
        """Sum over dimensions of (n*x - S)^2, exact; a list where a long may not hold it."""
        off = self.off(c)
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * max(1, off.shape[1]) < 1 << 63:
            d = off * self.n - self.r
            return (d * d).sum(1)
        return [sum((int(a) * self.n - int(b)) ** 2 for a, b in zip(row, self.r, strict=True)) for row in off]


def fit_sums(rows: DataFrame, dim: int, n: int, scale: int, shift: int) -> Fit:
    def work(batches):
        out = np.zeros((2, dim), dtype=np.int64)
        for b in batches:
            x = integers(matrix(b.column(0), dim), scale, shift)
            out += np.stack([(x >> 20).sum(0), (x & LOW).sum(0)])
        return out

    high, low = summed(rows, work, (2, dim), np.int64)
    sums = [(int(h) << 20) + int(x) for h, x in zip(high, low, strict=True)]
    return Fit(n, np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64), scale, shift)


def total_deviation(rows: DataFrame, dim: int, fit: Fit) -> int:
    """Sum of all deviations, exact, in limbs of 31 bits."""

    def work(batches):
        out = np.zeros(6, dtype=np.int64)
        for b in batches:
            d = fit.deviations(matrix(b.column(0), dim))
            if isinstance(d, list):
                d = np.array([[(x >> (31 * k)) & 0x7FFFFFFF for k in range(5)] + [x >> 155] for x in d], dtype=np.int64)
                out += d.sum(0)
            else:
                out[:3] += [int((d >> s & 0x7FFFFFFF).sum()) for s in (0, 31, 62)]
        return out

    return sum(int(x) << (31 * k) for k, x in enumerate(summed(rows, work, (6,), np.int64)))


def multiply(rows: DataFrame, dim: int, fit: Fit, q: np.ndarray) -> np.ndarray:
    """V·q, by one pass over the rows."""

    def work(batches):
        out = np.zeros(q.shape)
        for b in batches:
            c = matrix(b.column(0), dim)
            for at in range(0, len(c), SLICE):
                z = fit.centred(c[at : at + SLICE])
                out += z.T @ (z @ q)
        return out

    return summed(rows, work, q.shape) / fit.n


def against(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """``block`` without its part in the span of ``basis`` (twice, against rounding)."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def next_block(basis: np.ndarray, block: np.ndarray, floor: float, random: np.random.Generator) -> np.ndarray:
    """Orthonormal directions orthogonal to ``basis``: those of ``block``, random ones in place of those that broke down."""
    dim, have = basis.shape
    out = np.empty((dim, 0))
    for column in block.T[: dim - have]:
        whole = np.concatenate([basis, out], axis=1)
        v = against(whole, column[:, None])
        while np.linalg.norm(v) <= floor:  # breakdown: nothing new in this direction
            floor = 1e-8
            v = against(whole, random.standard_normal((dim, 1)))
        v = against(whole, v / np.linalg.norm(v))
        out = np.concatenate([out, v / np.linalg.norm(v)], axis=1)
    return out


def lanczos(apply, dim: int, k: int, *, block: int = 16, tolerance: float = 1e-14, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) and unit eigenvectors of a symmetric operator.

    Residuals at ``tolerance`` of the largest eigenvalue end it, confirmed by
    one further block, or a basis of the whole space.
    """
    random = np.random.default_rng(seed)
    basis = np.empty((dim, 0))
    image = np.empty((dim, 0))
    new = next_block(basis, random.standard_normal((dim, min(block, dim))), 1e-8, random)
    settled = 0
    while True:
        got = apply(new)
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, got], axis=1)
        t = basis.T @ image
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1][:k], y[:, ::-1][:, :k]
        scale = max(abs(values[0]), 1e-300)
        residual = np.linalg.norm(image @ y - (basis @ y) * values, axis=0).max()
        settled = settled + 1 if len(values) == k and residual <= tolerance * scale * np.sqrt(dim) else 0
        if basis.shape[1] == dim or settled > 1:
            vectors = basis @ y
            sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
            return values, vectors * np.where(sign == 0, 1, sign)
        new = next_block(basis, got, 1e-10 * scale, random)


def identity_error(rows: DataFrame, dim: int, fit: Fit, weights: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = weights.shape[1]
    if not k:
        return 0.0

    def work(batches):
        out = np.zeros((k + 1, k))
        for b in batches:
            c = matrix(b.column(0), dim)
            for at in range(0, len(c), SLICE):
                w = fit.centred(c[at : at + SLICE]) @ weights
                out[0] += w.sum(0)
                out[1:] += w.T @ w
        return out

    got = summed(rows, work, (k + 1, k)) / fit.n
    return float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(k)).max())


def whiten(df: DataFrame, *, components: int = 8, scale: int = 1024, shift: int = 100_000, block: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each usable vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    dim, n = common_length(source, "v")
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    source = source.where(F.size("v") == dim)
    rows = source.select("v")
    fit = fit_sums(rows, dim, n, scale, shift)
    trace = Fraction(total_deviation(rows, dim, fit), n**3)
    k = min(components, dim)
    values, vectors = lanczos(lambda q: multiply(rows, dim, fit, q), dim, k, block=block)
    live = values > max(dim * np.finfo(float).eps * max(values[0], 0.0), 0.0)
    weights = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), 0.0)
    share = [float(Fraction(float(e)) / trace) if ok and trace else 0.0 for e, ok in zip(values, live, strict=True)]
    error = identity_error(rows, dim, fit, weights[:, live])

    def run(batches):
        for b in batches:
            ids, c = b.column(0), matrix(b.column(1), dim)
            for at in range(0, len(c), SLICE):
                part = c[at : at + SLICE]
                m = len(part)
                d = fit.deviations(part)
                dev = pa.array([x if x < 1 << 63 else None for x in d] if isinstance(d, list) else d, pa.int64())
                again = pa.array(np.repeat(np.arange(m), k))
                w = fit.centred(part) @ weights
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, m).take(again),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, dtype=np.int64)),
                        dev.take(again),
                        pa.array(w.ravel(), mask=np.tile(~live, m)),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return source.mapInArrow(released(run), schema)
