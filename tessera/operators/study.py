"""Paired predictions of two models over one roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import ContractError, require_columns, require_unique


def paired_predictions(a: DataFrame, b: DataFrame) -> DataFrame:
    """record_id, y_a, p_a, y_b, p_b; both sides must hold the same records with the same labels.

    One full join finds missing records and differing labels together.
    """
    for df, name in ((a, "first"), (b, "second")):
        require_columns(df, {"record_id", "y", "p"}, f"{name} predictions")
        require_unique(df, ["record_id"], f"{name} predictions")
    joined = a.select("record_id", F.col("y").alias("y_a"), F.col("p").alias("p_a")).join(b.select("record_id", F.col("y").alias("y_b"), F.col("p").alias("p_b")), "record_id", "full")
    got = joined.agg(F.count_if(F.col("y_a").isNull() | F.col("y_b").isNull()).alias("missing"), F.count_if(F.col("y_a") != F.col("y_b")).alias("differing")).first()
    if got["missing"]:
        raise ContractError(f"rosters differ in {got['missing']} records")
    if got["differing"]:
        raise ContractError(f"labels differ in {got['differing']} records")
    return joined


def paired_difference(a: DataFrame, b: DataFrame, groups: DataFrame, replicates: int = 200, seed: int = 613) -> DataFrame:
    """Observed macro-F1 difference of two checked rosters, with a grouped bootstrap interval."""
    from tessera.operators.evaluation import counts, from_counts, paired_bootstrap

    pairs = paired_predictions(a, b).join(groups.select("record_id", "grp"), "record_id")
    d = pairs.select("grp", F.col("y_a").alias("y"), F.col("p_a").alias("pa"), F.col("p_b").alias("pb"))
    one = lambda c: d.withColumn("p", F.col(c)).agg(*counts()).select(from_counts()["macro_f1"].alias(c))
    seen = one("pa").crossJoin(one("pb")).select(F.round(F.col("pa") - F.col("pb"), 6).alias("observed"))
    return seen.crossJoin(paired_bootstrap(d, "grp", replicates, seed))
