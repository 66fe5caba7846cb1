"""Running sums, places and rising fits over ranges, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import prefix
from tessera.operators import shift as S
from tessera.operators.isotonic import isotonic, pool
from tessera.operators.prefix import placed_rows, running_sums


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 40)


def no_whole_window(df):
    """No window of the plan sorts all rows in one task."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SinglePartition" not in plan or "Window" not in plan


@pytest.mark.parametrize("down", [False, True])
def test_running_sums(spark, small_ranges, down):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 5).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b"))
    order = F.col("x").desc() if down else F.col("x").asc()
    got = running_sums(df, order, {"a": "ua", "b": "ub"}, {"b": "tb"})
    rows = sorted(df.collect(), key=lambda r: -r.x if down else r.x)
    ua = ub = 0
    want = {}
    for r in rows:
        ua, ub = ua + r.a, ub + (r.b or 0)
        want[r.x] = (ua, ub)
    assert {r.x: (r.ua, r.ub) for r in got.collect()} == want and {r.tb for r in got.collect()} == {ub}
    assert no_whole_window(got)


def test_running_sums_by_key_of_most_rows(spark, small_ranges):
    df = spark.range(900).select(F.when(F.col("id") % 9 < 8, "hot").when(F.col("id") % 2 == 0, "cold").alias("k"), "id")
    got = running_sums(df, F.col("id").asc(), {"id": "u"}, {"id": "t"}, ["k"])
    w = Window.partitionBy("k").orderBy("id")
    want = df.withColumn("u", F.sum("id").over(w)).withColumn("t", F.sum("id").over(Window.partitionBy("k")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_running_sums_of_nothing(spark):
    assert running_sums(spark.createDataFrame([], "x double, a long"), F.col("x").asc(), {"a": "u"}, {"a": "t"}).collect() == []


@pytest.mark.parametrize("distinct", [1, 3, 700])
def test_places_under_ties(spark, small_ranges, distinct):
    df = spark.range(700).select((F.col("id") % distinct / 10.0).alias("score"), "id").withColumn("key", F.col("id"))
    got = sorted((r.place, r.score, r.id, r.n) for r in placed_rows(df, [F.col("score"), F.col("key")]).collect())
    want = sorted((r.score, r.id) for r in df.collect())
    assert [(p, s, i) for p, s, i, _ in got] == [(p, s, i) for p, (s, i) in enumerate(want)] and {g[3] for g in got} == {700}


def test_rows_that_no_order_tells_apart_are_spread(spark, small_ranges):
    df = spark.range(600).select(F.lit(0.5).alias("score"))
    placed, parts = prefix.ranged(df, [F.col("score")])
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert parts == 15 and max(sizes) < 200
    assert sorted(r.place for r in placed_rows(df, [F.col("score")]).collect()) == list(range(600))


def test_equal_mass_bins_of_one_score(spark, small_ranges):
    d = spark.range(503).select(F.lit(0.25).alias("score"), "id")
    got = {r.bin: (r.n, r.low) for r in E.equal_mass_bins(d, ["id"]).groupBy("bin").agg(F.count("*").alias("n"), F.min("id").alias("low")).collect()}
    assert got == {i: (len(x), x[0]) for i, x in enumerate(np.array_split(np.arange(503), 10))}


def test_metrics_do_not_depend_on_ranges(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(int(a), int(b > 0.5), float(b), f"g{i % 3}") for i, (a, b) in enumerate(zip(r.integers(0, 2, 800), np.round(r.random(800), 2)))]
    df = spark.createDataFrame(rows, "y int, p int, score double, grp string")
    conf = df.withColumn("confidence", E.decision_confidence(F.col("score"), 0.5))
    two = df.select((F.col("y")).alias("side"), F.col("score").alias("x"))

    def every():
        out = [E.ranking_metrics(df), E.ranking_metrics(df, ["grp"]), E.operating_thresholds(df), E.threshold_for_coverage(conf, 0.7), E.risk_coverage(conf, [0.1, 0.5, 1.0]), E.adaptive_ece(df.withColumn("i", F.monotonically_increasing_id()), ["i"]), S.ecdf(two, "x"), S.ks_statistic(two, "x", "side")]
        return [sorted(map(str, x.collect())) for x in out]

    whole = every()
    monkeypatch.setattr(prefix, "RANGE_ROWS", 9)
    assert every() == whole


def plain_isotonic(rows):
    steps = {}
    for s, y in rows:
        n, k = steps.get(s, (0, 0.0))
        steps[s] = (n + 1, k + y)
    return [(s, n, k / n) for _, s, n, k in pool((0, s, n, k) for s, (n, k) in sorted(steps.items()))]


@pytest.mark.parametrize("shape", ["noise", "falling", "valley", "steps"])
def test_isotonic_over_many_ranges(spark, shape):
    r = np.random.default_rng(5)
    x = np.arange(3000) / 3000
    y = {"noise": r.integers(0, 2, 3000), "rising": x * 100, "falling": -x * 100, "valley": (x - 0.5) ** 2, "flat": x * 0 + 1, "steps": np.floor(x * 7) + r.integers(0, 2, 3000)}[shape]
    rows = [(float(a), float(b)) for a, b in zip(x, y)]
    r.shuffle(rows)
    df = spark.createDataFrame([tuple(map(float, t)) for t in rows], "score double, y double").repartition(3)
    got = sorted(map(tuple, isotonic(df, range_rows=400).collect()))
    want = plain_isotonic([tuple(map(float, t)) for t in rows])
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-9, atol=1e-9)
    assert isotonic(df.limit(0)).collect() == []


def test_isotonic_of_a_hundred_thousand_rising_scores(spark):
    df = spark.range(100_000).select((F.col("id") / 100_000).alias("score"), (F.col("id") % 100_000 / 1000).alias("y"))
    got = isotonic(df, range_rows=30_000)
    assert got.count() == 100_000 and got.where("abs(value - from_score * 100) > 1e-9").count() == 0
