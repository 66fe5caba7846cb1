"""Contracts on tables: required columns, checked joins, key sets, first rows, equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks what its reader requires."""


def require_columns(df: DataFrame, required: list[str] | set[str], label: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ContractError(f"{label} lacks columns: {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    found = duplicate_keys(df, keys).limit(5).collect()
    if found:
        raise ContractError(f"{label}: keys repeat, such as {[tuple(r)[:-1] for r in found]}")
    return df


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "m:m", suffixes: tuple[str, str] | None = None) -> DataFrame:
    """An equi-join whose cardinality (1:1, 1:m, m:1, m:m) is asserted first.

    With ``suffixes``, columns of one name on both sides get them.
    """
    many_left, many_right = validate.split(":")
    if many_left == "1":
        require_unique(left, on, "left side")
    if many_right == "1":
        require_unique(right, on, "right side")
    if suffixes:
        both = [c for c in left.columns if c in right.columns and c not in on]
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return left.join(right, on, how)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot: int = 100_000, how: str | None = None) -> DataFrame:
    """``rows`` with the columns of their group in ``groups`` (nulls where it has none; null keys match).

    Groups of more than ``hot`` rows (column ``size``) are few, at most the
    rows over ``hot``, and are broadcast, so that no task gets a whole one;
    the rest meet by key, by the join that ``how`` hints at.
    """
    names = {k: f"_g_{k}" for k in keys}
    own = groups.withColumnsRenamed(names)
    fits = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    big = F.broadcast(own.where(F.col(size) > hot))
    rest = own.where(F.col(size) <= hot)
    some = rows.join(big, fits, "left_anti").join(rest.hint(how) if how else rest, fits, "left")
    return some.unionByName(rows.join(big, fits)).drop(*names.values())


def distinct_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> bool:
    return key_difference(left, right, keys).isEmpty() and key_difference(right, left, keys).isEmpty()


def as_text(df: DataFrame) -> DataFrame:
    """Every column as a string, null as ''."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Equality as multisets of text rows, whatever the order."""
    a, b = as_text(left), as_text(right.select(left.columns))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, out: str, default=None) -> DataFrame:
    """Add ``out`` from a two-column mapping; a missing key gives ``default``."""
    m = mapping.select(F.col(key), F.col(value).alias(out))
    got = df.join(m, key, "left")
    return got if default is None else got.withColumn(out, F.coalesce(out, F.lit(default)))


def rank_within(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "rank", zero: bool = False) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rn - 1 if zero else rn)
