"""Exact deduplication with two passes of a Bloom filter.

Pass one sets, in a counting filter of two bits a slot (seen, seen twice),
the slots of every row's hash; the partial filters of the tasks are merged by
slices. Pass two tests every hash: a row one of whose slots was set once only
is certainly unique and goes straight through; only the others shuffle, and
grouping them exactly removes the filter's false alarms. The filter has 32
slots a row up to ``max_bits`` (64 MB by default), so what is broadcast is
bounded; beyond that more rows shuffle and the result stays the same.

Definite results: null text is empty; a null doc_id counts as larger than any
other; rows that repeat both doc_id and text stand or fall together in the
returned flags; an empty table gives no rows; further columns, of any name, are
ignored by ``dedup_exact`` and carried by ``drop_exact``, which keeps a single
row even of such repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.blocks import U64, mix
from tessera.runtime import Workspace

SLICE = 1 << 20  # slots
HASHES = 4
HELD = 1 << 19  # hashes that a task holds before it sends bits


def text_hash(text_col: str = "text") -> Column:
    """Lowercase hex SHA-256 of the text with every run of ASCII white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)


def _slots(x: np.ndarray, m: int) -> np.ndarray:
    a, b = mix(x.view(U64)), mix(x.view(U64) ^ U64(0x5851F42D4C957F2D)) | U64(1)
    return np.stack([(a + U64(j) * b) & U64(m - 1) for j in range(HASHES)]).astype(np.int64)


def _bits(slots: np.ndarray, at: int, size: int) -> bytes:
    got = np.zeros(size, dtype=np.uint8)
    got[slots - at] = 1
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(got).tobytes())


def _read(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)


class Filter:
    """Slices of 'seen twice' bits; unpacked once in a process."""

    def __init__(self, packed: dict[int, bytes]):
        self.packed, self.bits = packed, None

    def __getstate__(self):
        return {"packed": self.packed, "bits": None}

    def slices(self) -> dict[int, np.ndarray]:
        if self.bits is None:
            self.bits = {i: _read(b) for i, b in self.packed.items()}
        return self.bits


def repeat_filter(hashes: DataFrame, column: str, m: int) -> dict[int, bytes]:
    """Slices of the 'seen twice' bits over all values of a long column."""
    size = min(m, SLICE)

    def part(held: list[np.ndarray]) -> pa.RecordBatch:
        s = _slots(np.concatenate(held), m).reshape(-1)
        values, times = np.unique(s, return_counts=True)
        cuts = np.searchsorted(values, np.arange(0, m + size, size))
        rows = [(i, _bits(values[x:y], i * size, size), _bits(values[x:y][times[x:y] > 1], i * size, size)) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["slice", "once", "twice"])

    def local(batches):
        held, n = [], 0
        for b in batches:
            held.append(np.asarray(b.column(0).to_numpy(zero_copy_only=False), dtype=np.int64))
            n += len(held[-1])
            if n >= HELD:
                yield part(held)
                held, n = [], 0
        if n:
            yield part(held)

    def merge(t: pa.Table) -> pa.Table:
        once, twice = np.zeros(size // 8, dtype=np.uint8), np.zeros(size // 8, dtype=np.uint8)
        for o, w in zip(t.column("once").to_pylist(), t.column("twice").to_pylist(), strict=True):
            o = _read(o)
            twice |= _read(w) | (once & o)
            once |= o
        return pa.table({"slice": t.column("slice").slice(0, 1), "twice": pa.array([zstandard.ZstdCompressor().compress(twice.tobytes())], pa.binary())})

    sent = hashes.select(column).mapInArrow(local, "slice long, once binary, twice binary")
    # at most m / SLICE rows of SLICE / 8 bytes reach the driver
    return {r["slice"]: bytes(r["twice"]) for r in sent.groupBy("slice").applyInArrow(merge, "slice long, twice binary").collect()}


def _slots_for(n: int, max_bits: int) -> int:
    m = 1 << 15
    while m < 32 * n and m < max_bits:
        m *= 2
    return m


def maybe_repeated(spark, hashes: DataFrame, column: str, n: int, max_bits: int = 1 << 29):
    """A column function: whether a hash may occur more than once (never wrong when it says no)."""
    m = _slots_for(n, max_bits)
    size = min(m, SLICE)
    shared = spark.sparkContext.broadcast(Filter(repeat_filter(hashes, column, m)))

    @F.arrow_udf(T.BooleanType())
    def flag(x: pa.Array) -> pa.Array:
        s = _slots(np.asarray(x.to_numpy(zero_copy_only=False), dtype=np.int64), m)
        hit = np.ones(s.shape[1], dtype=bool)
        whole = shared.value.slices()
        for row in s:
            part, bit = row // size, row % size
            got = np.zeros(len(row), dtype=bool)
            for i in np.unique(part):
                own = part == i
                if (bits := whole.get(int(i))) is not None:
                    got[own] = (bits[bit[own] >> 3] >> (7 - (bit[own] & 7)).astype(np.uint8)) & 1
            hit &= got
        return pa.array(hit)

    return flag


def dedup_exact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 29) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    hashed = ws.keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_sha256")), "hashes")
    hashed = hashed.withColumn("x", F.xxhash64("text_sha256"))
    n = hashed.count()
    flag = maybe_repeated(spark, hashed, "x", n, max_bits)
    marked = hashed.withColumn("again", flag("x")).drop("x")
    marked = ws.keep(marked, "marked")
    alone = marked.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rest = marked.where("again").drop("again")
    groups = rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    many = ws.keep(groups.where("group_size > 1"), "groups")
    # groups of more than a two-thousandth of the rows number under 2,000: these are broadcast, so no task gets a whole one
    hot = f"group_size > {max(100, n // 2000)}"
    big = F.broadcast(many.where(hot))
    joined = rest.join(big, "text_sha256").unionByName(rest.join(big, "text_sha256", "left_anti").join(many.where(f"NOT ({hot})"), "text_sha256", "left"))
    one = F.col("group_size").isNull()
    joined = joined.select("doc_id", F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (one | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")
    return alone.union(joined)


def drop_exact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 29) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; rows that cannot repeat are not shuffled."""
    spark = docs.sparkSession
    hashed = docs.select(F.col(id_col), F.xxhash64(text_hash(text_col)).alias("x"))
    hashed = Workspace(spark).keep(hashed, "hashes")
    flag = maybe_repeated(spark, hashed, "x", hashed.count(), max_bits)
    cols = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    row = F.col("row")
    marked = docs.select(F.struct(*cols).alias("row"), F.col(id_col).alias("id"), text_hash(text_col).alias("sha")).withColumn("again", flag(F.xxhash64("sha")))
    alone = marked.where("not again").select("row")
    # min_by combines on the map side, so a hot text is one row a task
    rest = marked.where("again").groupBy("sha").agg(F.min_by(row, F.struct(F.col("id").isNull(), F.col("id"))).alias("row"))
    return alone.union(rest.select("row")).select("row.*")
