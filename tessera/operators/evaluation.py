"""Metrics of scored, labelled predictions; every function is one or two aggregations.

Predictions have ``y`` (1 for the positive class), ``p`` (the prediction, 0
or 1) and ``score``. Undefined metrics are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.draws import drawn_sums
from tessera.operators.prefix import placed_rows, running_sums

#: Bin edges as the doubles that an even division of [0, 1] gives.
EDGES = tuple(i * 0.1 for i in range(11))


def ratio(a: Column, b: Column, zero: float | None = 0.0) -> Column:
    """a / b; ``zero`` where b is 0."""
    return F.when(b == 0, F.lit(zero).cast("double")).otherwise(a / b)


def n_where(cond: Column) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0))


def counts() -> list[Column]:
    y, p = F.col("y") == 1, F.col("p") == 1
    return [F.count("*").alias("n"), n_where(y & p).alias("tp"), n_where(~y & p).alias("fp"), n_where(y & ~p).alias("fn"), n_where(~y & ~p).alias("tn")]


def from_counts() -> dict[str, Column]:
    """Metrics over tp, fp, fn, tn (class 1 is ``unreliable``, class 0 ``reliable``), both classes always in the average."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p1, r1, p0, r0 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fn), ratio(tn, tn + fp)
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return {
        "accuracy": ratio(tp + tn, n, None),
        "macro_f1": (f1 + f0) / 2,
        "weighted_f1": ratio(f1 * (tp + fn) + f0 * (tn + fp), n, None),
        "unreliable_precision": p1,
        "unreliable_recall": r1,
        "unreliable_f1": f1,
        "reliable_precision": p0,
        "reliable_recall": r0,
        "reliable_f1": f0,
    }


def macro_f1_present() -> Column:
    """Macro-F1 over the classes that occur among labels or predictions."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    has1, has0 = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return ratio(f1 * has1 + f0 * has0, (has1 + has0).cast("double"), None)


def classification_metrics(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    got = df.groupBy(*keys).agg(*counts())
    m = from_counts()
    return got.select(*keys, "n", (F.col("tp") + F.col("fn")).alias("unreliable_support"), (F.col("tn") + F.col("fp")).alias("reliable_support"), *[F.round(c, 6).alias(k) for k, c in m.items()])


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Fixed order of classes: reliable, then unreliable."""
    got = df.agg(*counts())
    rows = F.array(F.struct(F.lit("reliable").alias("actual"), F.col("tn").alias("predicted_reliable"), F.col("fp").alias("predicted_unreliable")), F.struct(F.lit("unreliable").alias("actual"), F.col("fn").alias("predicted_reliable"), F.col("tp").alias("predicted_unreliable")))
    return got.select(F.inline(rows))


def score_steps(df: DataFrame, keys: list[str] = (), totals: dict[str, str] | None = None) -> DataFrame:
    """One row per distinct score, with cumulative positives and negatives in falling order (``running_sums`` over ranges of scores)."""
    by = df.groupBy(*keys, "score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))
    return running_sums(by, F.col("score").desc(), {"pos": "ctp", "neg": "cfp"}, totals, keys)


def ranking_metrics(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """pr_auc (average precision over score steps) and roc_auc (ties count half); null unless both classes occur."""
    s = score_steps(df, keys, {"pos": "np", "neg": "nn"})
    ap = F.sum(F.col("pos") / F.col("np") * F.col("ctp") / (F.col("ctp") + F.col("cfp")))
    # negatives below a step count whole, those on it half
    auc = F.sum(F.col("pos") * ((F.col("nn") - F.col("cfp")) + F.col("neg") / 2)) / (F.first("np") * F.first("nn"))
    both = s.where("np > 0 AND nn > 0")
    got = both.groupBy(*keys).agg(F.round(ap, 6).alias("pr_auc"), F.round(auc, 6).alias("roc_auc"))
    return df.select(*keys).distinct().join(got, list(keys), "left") if keys else got


def bin_of(score: Column, edges: tuple[float, ...] = EDGES) -> Column:
    """Left-closed bins, the last closed on both sides."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = (score >= F.lit(edges[i])) & ((score <= F.lit(edges[i + 1])) if i == len(edges) - 2 else (score < F.lit(edges[i + 1])))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def reliability_table(df: DataFrame, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """A row per bin, empty ones too: count, mean score, share of positives."""
    spark = df.sparkSession
    got = df.groupBy(bin_of(F.col("score"), edges).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("y").cast("double")).alias("accuracy"))
    bins = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


def ece(df: DataFrame, edges: tuple[float, ...] = EDGES) -> DataFrame:
    got = df.groupBy(bin_of(F.col("score"), edges).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("c"), F.avg(F.col("y").cast("double")).alias("a"))
    return got.agg(F.round(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n"), 6).alias("ece"))


def equal_mass_bins(df: DataFrame, order: list[str], bins: int = 10) -> DataFrame:
    """``df`` with ``bin``: positions in score order divided into ``bins`` as even as can be.

    Places come from ranges of (score, ``order``), so no task sorts all rows,
    nor all rows of one score. Sizes are those of an even split: the first
    ``n mod bins`` bins have one row more.
    """
    placed = placed_rows(df, [F.col("score"), *map(F.col, order)], "_place", "_n")
    k = F.least(F.lit(bins), F.col("_n"))
    base, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    head = extra * (base + 1)
    b = F.when(F.col("_place") < head, F.floor(F.col("_place") / (base + 1))).otherwise(extra + F.floor((F.col("_place") - head) / base))
    return placed.withColumn("bin", b.cast("int")).drop("_place", "_n")


def adaptive_ece(df: DataFrame, order: list[str], bins: int = 10) -> DataFrame:
    got = equal_mass_bins(df, order, bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("c"), F.avg(F.col("y").cast("double")).alias("a"))
    return got.agg(F.round(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n"), 6).alias("adaptive_ece"))


def brier(score: str = "score") -> Column:
    return F.avg((F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) - F.col("y")) ** 2)


def decision_confidence(p: Column, threshold: float) -> Column:
    """Half plus half the margin to the threshold, relative to the room on that side."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie in [0, 1]")
    above = F.lit(1.0) if threshold == 1 else (p - threshold) / (1 - threshold)
    below = F.lit(1.0) if threshold == 0 else (threshold - p) / threshold
    bad = p.isNull() | F.isnan(p) | (p < 0) | (p > 1)
    return F.when(bad, F.raise_error(F.lit("probabilities must be finite and in [0, 1]")).cast("double")).otherwise(0.5 + 0.5 * F.when(p >= threshold, above).otherwise(below))


def threshold_for_coverage(df: DataFrame, coverage: float, column: str = "confidence") -> DataFrame:
    """The largest threshold that keeps at least ``coverage`` of the rows (kept: confidence >= threshold).

    Found over counts of distinct values, so nothing is sorted row by row.
    """
    if coverage >= 1:
        return df.limit(1).select(F.lit(0.0).alias("threshold"))
    by = df.groupBy(column).agg(F.count("*").alias("m"))
    kept = running_sums(by, F.col(column).desc(), {"m": "kept"}, {"m": "n"})
    return kept.where(F.col("kept") >= F.ceil(F.lit(coverage) * F.col("n"))).agg(F.max(column).alias("threshold"))


def risk_coverage(df: DataFrame, targets: list[float], column: str = "confidence") -> DataFrame:
    """(i, coverage, risk) at the first step of falling ``column`` that keeps a share of ``targets`` or more; i counts the targets from 0."""
    by = df.groupBy(column).agg(F.count("*").alias("m"), n_where(F.col("y") != F.col("p")).alias("e"))
    steps = running_sums(by, F.col(column).desc(), {"m": "kept", "e": "errors"}, {"m": "n"})
    t = df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(targets)], "i int, target double")
    # each target's first step, as the smallest of (kept, errors): one row a target and task before the exchange
    met = steps.join(F.broadcast(t), F.col("kept") >= F.ceil(F.round(F.col("target") * F.col("n"), 9)))
    first = met.groupBy("i").agg(F.min(F.struct("kept", "errors", "n")).alias("s"))
    return first.select("i", F.round(F.col("s.kept") / F.col("s.n"), 6).alias("coverage"), F.round(F.col("s.errors") / F.col("s.kept"), 6).alias("risk"))


def selective_result(df: DataFrame, threshold: float, decision: float = 0.5) -> DataFrame:
    """Quality of the rows kept at a confidence threshold, and what is put off."""
    keep = F.col("confidence") >= threshold
    hard = F.when(F.col("score") >= decision, 1).otherwise(0)
    d = df.withColumn("keep", keep).withColumn("p", hard)
    y, p, k = F.col("y") == 1, F.col("p") == 1, F.col("keep")
    got = d.agg(
        F.count("*").alias("n"), n_where(k).alias("kept"), n_where(~k).alias("deferred"),
        n_where(k & y & p).alias("tp"), n_where(k & ~y & p).alias("fp"), n_where(k & y & ~p).alias("fn"), n_where(k & ~y & ~p).alias("tn"),
        n_where(y).alias("pos"), n_where(k & y).alias("kept_pos"), n_where(~k & y).alias("deferred_pos"), n_where(~k & (y != p)).alias("deferred_errors"),
    )
    c = {x: F.col(x) for x in got.columns}
    return got.select(
        "n", "kept", "deferred",
        F.round(ratio(c["kept"], c["n"], None), 6).alias("coverage"),
        F.round(ratio(c["kept_pos"], c["pos"], None), 6).alias("coverage_unreliable"),
        F.round(ratio(c["kept"] - c["kept_pos"], c["n"] - c["pos"], None), 6).alias("coverage_reliable"),
        F.round(ratio(c["fp"] + c["fn"], c["kept"], None), 6).alias("risk"),
        F.round(macro_f1_present(), 6).alias("macro_f1"),
        F.round(ratio(c["deferred_errors"], c["deferred"], None), 6).alias("deferred_error_rate"),
        F.round(ratio(c["deferred_pos"], c["deferred"], None), 6).alias("deferred_unreliable_share"),
    )


def threshold_table(df: DataFrame) -> DataFrame:
    """tp, fp, fn, tn at 0, 0.5, 1 and every distinct score (positive: score >= threshold)."""
    steps = df.groupBy("score").agg(F.sum("y").cast("long").alias("pos"), F.count("*").alias("m"))
    extra = df.sparkSession.createDataFrame([(0.0, 0, 0), (0.5, 0, 0), (1.0, 0, 0)], "score double, pos long, m long")
    every = steps.unionByName(extra).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("m").alias("m"))
    t = running_sums(every, F.col("score").desc(), {"pos": "tp", "m": "above"}, {"pos": "np", "m": "n"})
    t = t.select(F.col("score").alias("threshold"), "tp", (F.col("above") - F.col("tp")).alias("fp"), "np", "n")
    return t.select("threshold", "tp", "fp", (F.col("np") - F.col("tp")).alias("fn"), (F.col("n") - F.col("np") - F.col("fp")).alias("tn"))


def operating_thresholds(df: DataFrame, recall: float = 0.9, precision: float = 0.8) -> DataFrame:
    """Thresholds by name: best macro-F1 (smallest on ties), recall first (largest), precision first (smallest); 0.5 where none fits."""
    t = threshold_table(df)
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    t = t.withColumn("pr", F.round(pr, 12)).withColumn("rc", F.round(rc, 12)).withColumn("f", F.round(macro_f1_present(), 12))
    got = t.agg(
        F.max_by("threshold", F.struct("f", (-F.col("threshold")).alias("t"))).alias("macro_f1"),
        F.max_by("threshold", F.when(F.col("rc") >= recall, F.struct("pr", F.col("threshold").alias("t")))).alias("recall_first"),
        F.max_by("threshold", F.when(F.col("pr") >= precision, F.struct("rc", (-F.col("threshold")).alias("t")))).alias("precision_first"),
    )
    return got.select(*[F.coalesce(c, F.lit(0.5)).alias(c) for c in got.columns])


def bootstrap_counts(df: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """tp, fp, fn, tn of every replicate, whole groups drawn together.

    Groups are reduced to counts first; replicates weigh only those, by
    Poisson(1) draws (the limit of drawing with replacement, without a total
    order of the groups).
    """
    return drawn_sums(df.groupBy(group).agg(*counts()), group, ["tp", "fp", "fn", "tn"], replicates, seed)


def bootstrap_intervals(df: DataFrame, group: str, replicates: int = 1000, seed: int = 613) -> DataFrame:
    """Mean and 95 % percentile interval of four metrics over grouped replicates."""
    m = from_counts()
    names = ("macro_f1", "unreliable_f1", "unreliable_recall", "accuracy")
    each = bootstrap_counts(df, group, replicates, seed).where("tp + fp + fn + tn > 0").select(*[m[k].alias(k) for k in names])
    long = each.unpivot([], list(names), "metric", "value")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(q[0], 6).alias("low"), F.round(q[1], 6).alias("high"))


def paired_bootstrap(df: DataFrame, group: str, replicates: int = 1000, seed: int = 613) -> DataFrame:
    """Difference of macro-F1 between predictions ``pa`` and ``pb`` over the same draws; each group is drawn once for both."""
    names = ("tp", "fp", "fn", "tn")
    both = [F.coalesce(F.count_if((F.col("y") == y) & (F.col(p) == v)), F.lit(0)).alias(f"{n}_{p}") for p in ("pa", "pb") for n, y, v in zip(names, (1, 0, 1, 0), (1, 1, 0, 0), strict=True)]
    drawn = drawn_sums(df.groupBy(group).agg(*both), group, [f"{n}_{p}" for p in ("pa", "pb") for n in names], replicates, seed)

    def macro(p: str) -> Column:
        tp, fp, fn, tn = (F.col(f"{n}_{p}") for n in names)
        return (ratio(2 * tp, 2 * tp + fp + fn) + ratio(2 * tn, 2 * tn + fp + fn)) / 2

    d = drawn.select((macro("pa") - macro("pb")).alias("d"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return d.agg(F.round(F.avg("d"), 6).alias("mean"), F.round(q[0], 6).alias("low"), F.round(q[1], 6).alias("high"))


def equivalence(df: DataFrame, margin: float = 0.03) -> DataFrame:
    """By dataset and model: how many runs have their interval strictly inside the margin, and whether all do."""
    inside = (F.col("low") > -margin) & (F.col("high") < margin)
    return df.groupBy("dataset", "model").agg(
        F.count("*").alias("runs"), F.array_join(F.array_sort(F.collect_set(F.col("seed").cast("string"))), ",").alias("seeds"),
        F.round(F.avg("difference"), 6).alias("mean_difference"), F.min("difference").alias("min_difference"), F.max("difference").alias("max_difference"),
        n_where(inside).alias("supporting"), F.bool_and(inside).alias("all_support"),
    )
