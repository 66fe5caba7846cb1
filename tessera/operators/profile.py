"""Profiles of tables: missing values, data dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missingness(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Share of blank values of every column: one pass, then one row a column."""
    blank = [F.round(F.avg((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").cast("double")), 6).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*blank).unpivot(keys, columns, "column_name", "blank")


def data_dictionary(df: DataFrame) -> DataFrame:
    """Name, type and number of present values of every column."""
    types = F.create_map(*[F.lit(x) for kv in df.dtypes for x in kv])
    got = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "present")
    return got.select("column_name", types[F.col("column_name")].alias("dtype"), "present")
