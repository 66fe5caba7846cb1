"""Additive explanations of linear scores, and how stable they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contributions(tfidf: DataFrame, weights: DataFrame) -> DataFrame:
    """record_id, term, contribution: value times weight of every term that has a weight."""
    return tfidf.join(weights, "term").select("record_id", "term", (F.col("tfidf") * F.col("weight")).alias("contribution"))


def reconstruct(contrib: DataFrame, intercept: float) -> DataFrame:
    return contrib.groupBy("record_id").agg((F.sum("contribution") + F.lit(intercept)).alias("score"))


def top_by_sign(df: DataFrame, keys: list[str], feature: str, k: int) -> DataFrame:
    """The k largest contributions of each sign (ties: feature order)."""
    w = Window.partitionBy(*keys, "positive").orderBy(F.abs("contribution").desc(), feature)
    return df.where("contribution <> 0").withColumn("positive", F.col("contribution") > 0).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def top_abs(df: DataFrame, keys: list[str], feature: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.abs("contribution").desc(), feature)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def stability(a: DataFrame, b: DataFrame, keys: list[str], feature: str = "feature") -> DataFrame:
    """Jaccard, sign agreement and cosine of two sets of top contributions by key.

    Both empty: Jaccard 1; no shared feature: sign agreement null.
    """
    x = a.select(*keys, feature, F.col("contribution").alias("ca"))
    y = b.select(*keys, feature, F.col("contribution").alias("cb"))
    j = x.join(y, [*keys, feature], "full")
    both = F.col("ca").isNotNull() & F.col("cb").isNotNull()
    norm = F.sqrt(F.sum(F.col("ca") ** 2)) * F.sqrt(F.sum(F.col("cb") ** 2))
    return j.groupBy(*keys).agg(
        F.round(F.count_if(both) / F.count("*"), 6).alias("jaccard"),
        F.round(F.avg(F.when(both, (F.signum("ca") == F.signum("cb")).cast("double"))), 6).alias("sign_agreement"),
        F.round(F.try_divide(F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0.0)), norm), 6).alias("cosine"),
    )


def refit_agreement(saved: DataFrame, refit: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Share of equal predictions, greatest score gap, and whether the refit counts as the same model."""
    j = saved.select("record_id", F.col("p").alias("pa"), F.col("score").alias("sa")).join(refit.select("record_id", F.col("p").alias("pb"), F.col("score").alias("sb")), "record_id")
    agree, gap = F.avg((F.col("pa") == F.col("pb")).cast("double")), F.max(F.abs(F.col("sa") - F.col("sb")))
    return j.agg(agree.alias("agreement"), gap.alias("max_gap"), ((agree == 1) & (gap <= tolerance)).alias("verified"))
