import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import models as M
from tessera.operators import shift as S
from tessera.operators.isotonic import isotonic
from tessera.operators.relational import ContractError
from tessera.operators.study import paired_predictions


def preds(spark, rows):
    return spark.createDataFrame(rows, "y int, p int, score double, grp string")


FOUR = [(0, 0, 0.1, "a"), (0, 1, 0.8, "a"), (1, 1, 0.7, "b"), (1, 1, 0.9, "b")]


def test_four_predictions(spark):
    m = E.classification_metrics(preds(spark, FOUR)).first()
    assert (m.reliable_recall, m.unreliable_recall, m.accuracy) == (0.5, 1.0, 0.75)
    b = {r.metric: r for r in E.bootstrap_intervals(preds(spark, FOUR), "grp", 50).collect()}
    assert len(b) == 4 and all(r.low <= r.mean <= r.high for r in b.values())
    r = E.ranking_metrics(preds(spark, FOUR)).first()
    assert r.roc_auc == 0.75 and r.pr_auc == pytest.approx(5 / 6, abs=1e-6)
    none = E.ranking_metrics(preds(spark, FOUR[:2])).first()
    assert none.roc_auc is None and none.pr_auc is None


def test_auc_against_numpy(spark):
    r = np.random.default_rng(1)
    y, s = r.integers(0, 2, 300), np.round(r.random(300), 1)
    got = E.ranking_metrics(preds(spark, [(int(a), 0, float(b), "g") for a, b in zip(y, s)])).first()
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert got.roc_auc == pytest.approx(want, abs=1e-6)


def test_confidence(spark):
    df = spark.createDataFrame([(0.0,), (0.125,), (0.25,), (0.625,), (1.0,)], "p double")
    assert [r[0] for r in df.select(E.decision_confidence(F.col("p"), 0.25)).collect()] == [1, 0.75, 0.5, 0.75, 1]
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([(1.5,)], "p double").select(E.decision_confidence(F.col("p"), 0.5)).collect()


def test_coverage(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.1, 0.2, 0.4, 0.8)], "score double").withColumn("confidence", E.decision_confidence(F.col("score"), 0.2))
    assert E.threshold_for_coverage(df, 0.4).first()[0] == pytest.approx(0.875)
    t = E.threshold_for_coverage(df, 0.7).first()[0]
    assert df.where(F.col("confidence") >= t).count() == 4
    assert E.threshold_for_coverage(df, 1.0).first()[0] == 0.0


def test_bins_and_even_mass(spark):
    df = preds(spark, [(0, 0, x / 10, "g") for x in range(11)])
    assert [r.n for r in E.reliability_table(df).orderBy("bin").collect()][-1] == 2
    for n in (7, 10, 23):
        d = spark.range(n).select((F.col("id") % 5 / 5).alias("score"), "id")
        got = sorted(r["count"] for r in E.equal_mass_bins(d, ["id"]).groupBy("bin").count().collect())
        assert got == sorted(len(x) for x in np.array_split(np.arange(n), min(10, n)))


def test_operating_thresholds_ties(spark):
    df = preds(spark, [(0, 0, 0.2, "g"), (0, 0, 0.2, "g"), (1, 1, 0.9, "g"), (1, 1, 0.9, "g")])
    t = E.operating_thresholds(df).first()
    assert (t.macro_f1, t.recall_first, t.precision_first) == (0.5, 0.9, 0.5)


def test_equivalence(spark):
    rows = [("d", "m", 1, 0.0, -0.01, 0.01), ("d", "m", 2, 0.0, -0.03, 0.01)]
    r = E.equivalence(spark.createDataFrame(rows, "dataset string, model string, seed int, difference double, low double, high double")).first()
    assert (r.runs, r.supporting, r.all_support, r.seeds) == (2, 1, False, "1,2")


def test_paired_contracts(spark):
    a = spark.createDataFrame([("a", 1, 1), ("b", 0, 1)], "record_id string, y int, p int")
    with pytest.raises(ContractError, match="rosters"):
        paired_predictions(a, a.where("record_id = 'a'"))
    with pytest.raises(ContractError, match="labels"):
        paired_predictions(a, a.withColumn("y", F.lit(1)))
    with pytest.raises(ContractError, match="repeat"):
        paired_predictions(a.union(a), a)


def test_shift_measures(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (0, "a", 1.0), (1, "b", 3.0), (1, None, 5.0)], "side int, k string, x double")
    c = S.with_shares(S.aligned(df.where("k IS NOT NULL"), "k", "side")).agg(S.js_divergence().alias("js"), S.tv_distance().alias("tv")).first()
    assert (c.js, c.tv) == (1.0, 1.0)
    r = S.categorical_shift(df, "k", "side").first()
    assert (r.categories, r.target_missing_share, r.jaccard) == (3, 0.5, 0.0)
    assert S.ks_statistic(df, "x", "side").first()[0] == 1.0
    assert df.agg(S.smd("x", "side")).first()[0] == pytest.approx(3 / math.sqrt(1.0))
    v = spark.createDataFrame([(0, ["aa", "bb"]), (0, ["cc"]), (1, ["aa"]), (1, ["dd", "ee"])], "side int, t array<string>")
    s = S.vocab_shift(S.vocabulary(v, F.col("t"), "side")).first()
    assert s.jaccard == pytest.approx(1 / 5) and s.target_token_coverage == pytest.approx(1 / 3, abs=1e-6)
    mix = S.topic_mix(spark.createDataFrame([(0, [1.0, 3.0]), (0, [0.0, 0.0])], "side int, w array<double>"), "w", "side").collect()
    assert sum(r.share for r in mix) == pytest.approx(1.0)


def test_platt_and_isotonic(spark):
    r = np.random.default_rng(0)
    s = r.random(3000)
    y = (r.random(3000) < 1 / (1 + np.exp(-(0.5 + 1.5 * np.log(s / (1 - s)))))).astype(int)
    df = preds(spark, [(int(a), 0, float(b), "g") for a, b in zip(y, s)])
    a, b = M.platt(df)
    assert abs(a - 0.5) < 0.2 and abs(b - 1.5) < 0.25
    iso = isotonic(df).toPandas().sort_values("from_score")
    assert iso.value.is_monotonic_increasing and iso.n.sum() == 3000
    assert M.isotonic_allowed(1000, 200) and not M.isotonic_allowed(999, 400) and not M.isotonic_allowed(2000, 199)
