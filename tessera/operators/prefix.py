"""Running sums and places over a whole order, without one task that sorts it.

Rows are dealt by ranges of the order and written with the number of their
range; totals of the ranges (one row each, so as many as partitions) give
what lies before every range, and windows run inside ranges only.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import Workspace

#: Rows that a window inside one range sorts; ranges beyond MOST_RANGES grow instead.
RANGE_ROWS = 250_000
MOST_RANGES = 4096


def ranged(df: DataFrame, order: list[Column], keys: list[str] = (), range_rows: int | None = None) -> tuple[DataFrame, int]:
    """``df``, written, with ``_range``: ranges of ``keys`` and ``order``, ascending; and how many ranges there may be.

    Rows that ``order`` does not tell apart are spread as well, in any order.
    """
    ws = Workspace(df.sparkSession, rest=2.0)
    kept = ws.keep(df, "steps")
    parts = min(MOST_RANGES, -(-kept.count() // (range_rows or RANGE_ROWS)))
    if parts <= 1:
        return kept.withColumn("_range", F.lit(0)), 1
    dealt = kept.withColumn("_tie", F.rand(11)).repartitionByRange(parts, *keys, *order, "_tie")
    placed = ws.keep(dealt.drop("_tie").withColumn("_range", F.spark_partition_id()), "ranges")
    ws.drop(kept)
    return placed, parts


def running_sums(df: DataFrame, order: Column, sums: dict[str, str], totals: dict[str, str] | None = None, keys: list[str] = (), range_rows: int | None = None) -> DataFrame:
    """Sums from the first row of the order up to each row, and over all rows.

    ``sums`` names the new column of each summed column, ``totals`` those of
    totals. Within ``keys`` a value of ``order`` occurs once. Null counts as 0.
    """
    keys, totals = list(keys), totals or {}
    placed, parts = ranged(df, [order], keys, range_rows)
    names = sorted({*sums, *totals})
    per = placed.groupBy(*keys, "_range").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_s_{c}") for c in names])
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    offsets, fits = _before(per, names, keys)
    out = placed.withColumns({new: F.sum(F.coalesce(F.col(c), F.lit(0))).over(inside) for c, new in sums.items()}).join(offsets, fits)
    out = out.withColumns({new: F.col(f"_b_{c}") + F.col(new) for c, new in sums.items()} | {new: F.col(f"_t_{c}") for c, new in totals.items()})
    return out.select(*df.columns, *sums.values(), *totals.values())


def _before(per: DataFrame, names: list[str], keys: list[str]) -> tuple[DataFrame, list[Column]]:
    """Of sums ``_s_x`` by keys and range: ``_b_x`` before a range and ``_t_x`` over all, and how to join them."""
    if keys:
        before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in names], *[F.sum(f"_s_{c}").over(Window.partitionBy(*keys)).alias(f"_t_{c}") for c in names])
        return offsets, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_range") == F.col("_r")]
    rows = sorted(per.collect(), key=lambda r: r["_range"])  # one row a range
    kinds = dict(per.dtypes)
    schema = "_r int, " + ", ".join(f"_b_{c} {kinds[f'_s_{c}']}, _t_{c} {kinds[f'_s_{c}']}" for c in names)
    before = {c: [0, *accumulate(r[f"_s_{c}"] for r in rows)] for c in names}
    offsets = per.sparkSession.createDataFrame([(r["_range"], *(x for c in names for x in (before[c][i], before[c][-1]))) for i, r in enumerate(rows)], schema)
    return F.broadcast(offsets), [F.col("_range") == F.col("_r")]


def placed_rows(df: DataFrame, order: list[Column], place: str = "place", total: str = "n", keys: list[str] = (), range_rows: int | None = None) -> DataFrame:
    """``df`` with the place of every row (from 0) in ``order`` within ``keys``, ties in any order, and the number of rows there.

    One value of the order, or one key, may hold most rows: they are spread over ranges.
    """
    keys = list(keys)
    dealt, _ = ranged(df, order, keys, range_rows)
    offsets, fits = _before(dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_s_rows")), ["rows"], keys)
    rank = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return dealt.withColumn("_rank", rank).join(offsets, fits).select(*df.columns, (F.col("_b_rows") + F.col("_rank") - 1).alias(place), F.col("_t_rows").alias(total))
