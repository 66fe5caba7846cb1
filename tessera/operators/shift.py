"""Differences between two cohorts: distributions, lengths, categories, vocabulary, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import running_sums
from tessera.runtime import Workspace

MISSING = "(missing)"


def coded(c: Column) -> Column:
    """A category as text; null and blank are (missing)."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(t == "", MISSING).otherwise(t)


def aligned(df: DataFrame, key: str, side: str) -> DataFrame:
    """Counts ``s`` and ``t`` of every value of ``key`` on the two sides (``side``: 0 or 1)."""
    return df.groupBy(key).agg(F.count_if(F.col(side) == 0).alias("s"), F.count_if(F.col(side) == 1).alias("t"))


def with_shares(counts: DataFrame) -> DataFrame:
    """``counts`` (written once) with shares ps and pt of the two sides."""
    kept = Workspace(counts.sparkSession, rest=2.0).keep(counts, "counts")
    total = kept.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    return kept.withColumn("ps", F.try_divide("s", F.lit(total["s"]))).withColumn("pt", F.try_divide("t", F.lit(total["t"])))


def _kl(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def js_divergence() -> Column:
    """Jensen-Shannon divergence in bits over rows with shares ps and pt."""
    m = (F.col("ps") + F.col("pt")) / 2
    return F.sum(0.5 * _kl(F.col("ps"), m) + 0.5 * _kl(F.col("pt"), m))


def tv_distance() -> Column:
    return 0.5 * F.sum(F.abs(F.col("ps") - F.col("pt")))


def ecdf(df: DataFrame, x: str) -> DataFrame:
    """Right-continuous distribution function at every value that occurs."""
    g = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("m"))
    return running_sums(g, F.col(x).asc(), {"m": "_up"}, {"m": "_n"}).select(x, (F.col("_up") / F.col("_n")).alias("f"))


def ks_statistic(df: DataFrame, x: str, side: str) -> DataFrame:
    """Largest gap between the two distribution functions; non-finite values are left out."""
    v = F.col(x).cast("double")
    d = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    g = running_sums(aligned(d, x, side), F.col(x).asc(), {"s": "us", "t": "ut"}, {"s": "ns", "t": "nt"})
    gap = F.abs(F.try_divide("us", "ns") - F.try_divide("ut", "nt"))
    return g.select(gap.alias("gap")).agg(F.max("gap").alias("ks"))


def smd(x: str, side: str) -> Column:
    """Mean difference (target less source) over the pooled sample deviation; 0 for equal constants, null for differing ones or fewer than two finite values."""
    v = F.col(x).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    s, t = F.when(F.col(side) == 0, v), F.when(F.col(side) == 1, v)
    pooled = F.sqrt(((F.count(s) - 1) * F.var_samp(s) + (F.count(t) - 1) * F.var_samp(t)) / (F.count(s) + F.count(t) - 2))
    gap = F.avg(t) - F.avg(s)
    return F.when((F.count(s) < 2) | (F.count(t) < 2), None).when(pooled == 0, F.when(gap == 0, 0.0)).otherwise(gap / pooled)


def length_profile(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    q = F.percentile(x, F.array(*[F.lit(v) for v in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"),
        *[F.round(q[i], 6).alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))],
    )


def categorical_shift(df: DataFrame, key: str, side: str) -> DataFrame:
    """One row: distances, overlap, concentration and missing share of two category distributions."""
    c = with_shares(aligned(df.withColumn("k", coded(F.col(key))), "k", side))
    both = (F.col("s") > 0) & (F.col("t") > 0)
    return c.agg(
        F.count("*").alias("categories"), F.count_if(F.col("s") > 0).alias("source_categories"), F.count_if(F.col("t") > 0).alias("target_categories"),
        F.round(F.count_if(both) / F.count("*"), 6).alias("jaccard"),
        F.round(F.sum(F.when(both, F.col("pt")).otherwise(0.0)), 6).alias("target_overlap_share"),
        F.round(tv_distance(), 6).alias("tv"), F.round(js_divergence(), 6).alias("js"),
        F.round(F.max("ps"), 6).alias("source_top1"), F.round(F.max("pt"), 6).alias("target_top1"),
        F.round(F.sum(F.col("ps") ** 2), 6).alias("source_hhi"), F.round(F.sum(F.col("pt") ** 2), 6).alias("target_hhi"),
        F.round(1 / F.sum(F.col("ps") ** 2), 6).alias("source_effective"), F.round(1 / F.sum(F.col("pt") ** 2), 6).alias("target_effective"),
        F.round(F.coalesce(F.sum(F.when(F.col("k") == MISSING, F.col("pt"))), F.lit(0.0)), 6).alias("target_missing_share"),
    )


def vocabulary(docs: DataFrame, tokens: Column, side: str) -> DataFrame:
    """Counts of every token on the two sides: one explode, combined before the shuffle."""
    return aligned(docs.select(F.col(side), F.explode(tokens).alias("term")), "term", side)


def vocab_shift(counts: DataFrame, max_features: int = 5000, least: int = 1) -> DataFrame:
    """One row over the ``max_features`` most frequent terms (ties: term order)."""
    top = counts.withColumn("n", F.col("s") + F.col("t")).orderBy(F.desc("n"), "term").limit(max_features)
    c = with_shares(top)
    a, b = F.col("s") >= least, F.col("t") >= least
    return c.agg(
        F.count("*").alias("terms"), F.count_if(a).alias("source_terms"), F.count_if(b).alias("target_terms"),
        F.round(F.try_divide(F.count_if(a & b).cast("double"), F.count_if(a | b)), 6).alias("jaccard"),
        F.round(F.try_divide(F.sum(F.when(a, F.col("t")).otherwise(0)).cast("double"), F.sum("t")), 6).alias("target_token_coverage"),
        F.round(js_divergence(), 6).alias("js"),
    )


def enriched_terms(counts: DataFrame, k: int = 20, max_features: int = 5000) -> DataFrame:
    """Terms whose share grew most, with a smoothed log ratio."""
    top = counts.withColumn("n", F.col("s") + F.col("t")).orderBy(F.desc("n"), "term").limit(max_features)
    c = with_shares(top)
    all_ = Window.partitionBy()
    v = F.count("*").over(all_)
    ratio = F.log2(((F.col("t") + 0.5) / (F.sum("t").over(all_) + 0.5 * v)) / ((F.col("s") + 0.5) / (F.sum("s").over(all_) + 0.5 * v)))
    c = c.withColumn("log2_ratio", ratio).withColumn("delta", F.round(F.col("pt") - F.col("ps"), 9))
    return c.orderBy(F.desc("delta"), "term").limit(k).select("term", "s", "t", F.round("delta", 6).alias("delta"), F.round("log2_ratio", 6).alias("log2_ratio"))


def topic_mix(df: DataFrame, weights: str, side: str) -> DataFrame:
    """Mean share of every topic on each side; a row without positive weight is unassigned (-1)."""
    w = F.transform(weights, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    d = df.select(side, w.alias("w"), total.alias("total"))
    share = F.when(F.col("total") > 0, F.transform("w", lambda x: x / F.col("total")))
    n = d.groupBy(side).agg(F.count("*").alias("n"))
    long = d.select(side, F.posexplode(share).alias("topic", "v")).groupBy(side, "topic").agg(F.sum("v").alias("v"))
    none = d.where("total <= 0").groupBy(side).agg(F.count("*").cast("double").alias("v")).select(side, F.lit(-1).alias("topic"), "v")
    return long.unionByName(none).join(n, side).select(side, "topic", F.round(F.col("v") / F.col("n"), 5).alias("share"))


def domain_exclusion(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of the target whose ``key`` the source has (removed), and the rest."""
    seen = source.where(F.trim(F.coalesce(key, F.lit(""))) != "").select(key).distinct().withColumn("hit", F.lit(True))
    j = target.join(seen, key, "left")
    n, gone = F.count("*"), F.count_if(F.col("hit"))
    return j.agg(n.alias("n"), gone.alias("removed"), (n - gone).alias("remaining"), F.round(F.try_divide(gone.cast("double"), n), 6).alias("removed_share"))
