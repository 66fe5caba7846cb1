"""Metrics, calibration, bootstrap and shift over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import shift as S
from tessera.plans.adapters import ITEMS, KEYED, PREDS, items, keyed, predictions, table
from tessera.plans.registry import query

COUNTS = "count(*) AS n, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn"
F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"
F0 = "CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2.0 * tn / (2 * tn + fp + fn) END"
R = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE 1.0 * {a} / ({b}) END"
METRICS = f"""n, tp + fn AS unreliable_support, tn + fp AS reliable_support, round(1.0 * (tp + tn) / n, 6) AS accuracy, round(({F1} + {F0}) / 2, 6) AS macro_f1,
    round((({F1}) * (tp + fn) + ({F0}) * (tn + fp)) / n, 6) AS weighted_f1, round({R('tp', 'tp + fp')}, 6) AS unreliable_precision, round({R('tp', 'tp + fn')}, 6) AS unreliable_recall, round({F1}, 6) AS unreliable_f1,
    round({R('tn', 'tn + fn')}, 6) AS reliable_precision, round({R('tn', 'tn + fp')}, 6) AS reliable_recall, round({F0}, 6) AS reliable_f1"""
STEPS = "steps AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM preds GROUP BY 1), cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS ctp, sum(neg) OVER (ORDER BY score DESC) AS cfp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM steps)"
EDGES = [repr(i * 0.1) + ("e0" if "e" not in repr(i * 0.1) else "") for i in range(11)]
BIN = "CASE " + " ".join(f"WHEN score >= {EDGES[i]} AND score {'<=' if i == 9 else '<'} {EDGES[i + 1]} THEN {i}" for i in range(10)) + " END"
CONF = "CASE WHEN score >= 0.5e0 THEN 0.5e0 + 0.5e0 * ((score - 0.5e0) / (1 - 0.5e0)) ELSE 0.5e0 + 0.5e0 * ((0.5e0 - score) / 0.5e0) END"
BINNED = f"b AS (SELECT {BIN} AS bin, count(*) AS n, avg(score) AS c, avg(CAST(y AS DOUBLE)) AS a FROM preds GROUP BY 1)"


@query("classification_metrics", f"WITH {PREDS}, c AS (SELECT {COUNTS} FROM preds) SELECT {METRICS} FROM c")
def classification_metrics(spark, sf):
    return E.classification_metrics(predictions(spark, sf))


@query("agg_subgroup", f"WITH {PREDS}, c AS (SELECT status, {COUNTS} FROM preds GROUP BY 1) SELECT status, {METRICS} FROM c")
def agg_subgroup(spark, sf):
    return E.classification_metrics(predictions(spark, sf), ["status"])


@query("confusion_matrix", f"WITH {PREDS}, c AS (SELECT {COUNTS} FROM preds) SELECT 'reliable' AS actual, tn AS predicted_reliable, fp AS predicted_unreliable FROM c UNION ALL SELECT 'unreliable', fn, tp FROM c")
def confusion_matrix(spark, sf):
    return E.confusion_matrix(predictions(spark, sf))


@query("metrics_long", f"WITH {PREDS}, c AS (SELECT {COUNTS} FROM preds) SELECT 'accuracy' AS metric, round(1.0 * (tp + tn) / n, 6) AS value FROM c UNION ALL SELECT 'macro_f1', round(({F1} + {F0}) / 2, 6) FROM c")
def metrics_long(spark, sf):
    return E.classification_metrics(predictions(spark, sf)).unpivot([], ["accuracy", "macro_f1"], "metric", "value")


@query("pr_auc", f"WITH {PREDS}, {STEPS} SELECT round(sum(1.0e0 * pos / np * ctp / (ctp + cfp)), 6) AS pr_auc FROM cum")
def pr_auc(spark, sf):
    return E.ranking_metrics(predictions(spark, sf)).select("pr_auc")


@query("roc_auc", f"WITH {PREDS}, {STEPS} SELECT round(sum(pos * ((nn - cfp) + neg / 2.0e0)) / (max(np) * max(nn)), 6) AS roc_auc FROM cum")
def roc_auc(spark, sf):
    return E.ranking_metrics(predictions(spark, sf)).select("roc_auc")


@query("win_cum_pr_roc", f"WITH {PREDS}, {STEPS} SELECT score, CAST(ctp AS BIGINT) AS ctp, CAST(cfp AS BIGINT) AS cfp FROM cum")
def win_cum_pr_roc(spark, sf):
    return E.score_steps(predictions(spark, sf)).select("score", "ctp", "cfp")


@query("ece", f"WITH {PREDS}, {BINNED} SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b")
def ece(spark, sf):
    return E.ece(predictions(spark, sf))


@query("reliability_table", f"WITH {PREDS}, {BINNED}, r AS (SELECT CAST(unnest(generate_series(0, 9)) AS INTEGER) AS bin) SELECT r.bin, coalesce(b.n, 0) AS n, round(b.c, 6) AS confidence, round(b.a, 6) AS accuracy FROM r LEFT JOIN b ON r.bin = b.bin")
def reliability_table(spark, sf):
    return E.reliability_table(predictions(spark, sf))


@query("adaptive_ece", f"WITH {KEYED}, q AS (SELECT y, score_a AS score, ntile(10) OVER (ORDER BY score_a, record_id) AS bin FROM keyed), b AS (SELECT bin, count(*) AS n, avg(score) AS c, avg(CAST(y AS DOUBLE)) AS a FROM q GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS adaptive_ece FROM b")
def adaptive_ece(spark, sf):
    return E.adaptive_ece(keyed(spark, sf).withColumn("score", F.col("score_a")), ["record_id"])


@query("calibration_metrics", f"WITH {PREDS}, {BINNED} SELECT (SELECT round(avg((score - y) * (score - y)), 6) FROM preds) AS brier, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b")
def calibration_metrics(spark, sf):
    p = predictions(spark, sf)
    return p.agg(F.round(E.brier(), 6).alias("brier")).crossJoin(E.ece(p))


@query("decision_confidence", f"WITH {PREDS} SELECT score, round({CONF}, 6) AS confidence, count(*) AS n FROM preds GROUP BY 1, 2")
def decision_confidence(spark, sf):
    return predictions(spark, sf).groupBy("score", F.round(E.decision_confidence(F.col("score"), 0.5), 6).alias("confidence")).agg(F.count("*").alias("n"))


def with_confidence(spark, sf):
    return predictions(spark, sf).withColumn("confidence", E.decision_confidence(F.col("score"), 0.5))


@query("threshold_for_coverage", f"WITH {PREDS}, c AS (SELECT {CONF} AS confidence FROM preds), r AS (SELECT confidence, row_number() OVER (ORDER BY confidence DESC) AS rn, count(*) OVER () AS n FROM c) SELECT round(max(confidence), 6) AS threshold FROM r WHERE rn = ceil(0.7 * n)")
def threshold_for_coverage(spark, sf):
    return E.threshold_for_coverage(with_confidence(spark, sf), 0.7).select(F.round("threshold", 6).alias("threshold"))


@query(
    "selective_result",
    f"""WITH {PREDS}, c AS (SELECT y, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS p, {CONF} >= 0.75 AS k FROM preds),
    g AS (SELECT count(*) AS n, count(*) FILTER (WHERE k) AS kept, count(*) FILTER (WHERE NOT k) AS deferred, count(*) FILTER (WHERE k AND y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE k AND y = 0 AND p = 1) AS fp,
    count(*) FILTER (WHERE k AND y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE k AND y = 0 AND p = 0) AS tn, sum(y) AS pos, count(*) FILTER (WHERE k AND y = 1) AS kp, count(*) FILTER (WHERE NOT k AND y = 1) AS dp, count(*) FILTER (WHERE NOT k AND y <> p) AS de FROM c)
    SELECT n, kept, deferred, round(1.0 * kept / n, 6) AS coverage, round(1.0 * kp / pos, 6) AS coverage_unreliable, round(1.0 * (kept - kp) / (n - pos), 6) AS coverage_reliable, round(1.0 * (fp + fn) / kept, 6) AS risk,
    round(({F1} + {F0}) / 2, 6) AS macro_f1, round(1.0 * de / deferred, 6) AS deferred_error_rate, round(1.0 * dp / deferred, 6) AS deferred_unreliable_share FROM g""",
)
def selective_result(spark, sf):
    return E.selective_result(with_confidence(spark, sf), 0.75)


@query("risk_coverage_curve", f"WITH {PREDS}, c AS (SELECT y, p, {CONF} AS confidence FROM preds), g AS (SELECT confidence, count(*) AS m, count(*) FILTER (WHERE y <> p) AS e FROM c GROUP BY 1), k AS (SELECT confidence, sum(m) OVER (ORDER BY confidence DESC) AS kept, sum(e) OVER (ORDER BY confidence DESC) AS err, sum(m) OVER () AS n FROM g), t AS (SELECT unnest(generate_series(2, 20)) AS i) SELECT CAST(i AS INTEGER) AS target, round(min(1.0 * kept / n), 6) AS coverage, round(1.0 * min(err) / min(kept), 6) AS risk FROM t JOIN k ON kept >= ceil(i * n / 20.0) GROUP BY 1")
def risk_coverage_curve(spark, sf):
    got = E.risk_coverage(with_confidence(spark, sf), [i / 20 for i in range(2, 21)])
    return got.select((F.col("i") + 2).alias("target"), "coverage", "risk")


@query("confidence_histogram", f"WITH {PREDS}, c AS (SELECT {CONF} AS confidence FROM preds) SELECT CAST(least(floor((round(confidence, 9) - 0.5) * 20), 9) AS INTEGER) AS bin, count(*) AS n FROM c GROUP BY 1")
def confidence_histogram(spark, sf):
    b = F.least(F.floor((F.round("confidence", 9) - 0.5) * 20), F.lit(9)).cast("int")
    return with_confidence(spark, sf).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query("deferral_flag", f"WITH {PREDS}, c AS (SELECT {CONF} AS confidence, y FROM preds) SELECT y, round(avg(CASE WHEN confidence < 0.8 THEN 1.0 ELSE 0.0 END), 6) AS deferral_rate FROM c GROUP BY 1")
def deferral_flag(spark, sf):
    return with_confidence(spark, sf).groupBy("y").agg(F.round(F.avg((F.col("confidence") < 0.8).cast("double")), 6).alias("deferral_rate"))


THRESH = f"""WITH {PREDS}, v AS (SELECT score AS t FROM preds UNION SELECT 0.0 UNION SELECT 0.5 UNION SELECT 1.0), g AS (SELECT score, sum(y) AS pos, count(*) AS m FROM preds GROUP BY 1),
    c AS (SELECT v.t AS threshold, coalesce(sum(g.pos) FILTER (WHERE g.score >= v.t), 0) AS tp, coalesce(sum(g.m - g.pos) FILTER (WHERE g.score >= v.t), 0) AS fp, sum(g.pos) AS np, sum(g.m) AS n FROM v CROSS JOIN g GROUP BY 1),
    d AS (SELECT threshold, tp, fp, np - tp AS fn, n - np - fp AS tn FROM c), e AS (SELECT threshold, round(CASE WHEN tp + fp = 0 THEN 0 ELSE 1.0 * tp / (tp + fp) END, 12) AS pr, round(CASE WHEN tp + fn = 0 THEN 0 ELSE 1.0 * tp / (tp + fn) END, 12) AS rc,
    round((CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END + CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2.0 * tn / (2 * tn + fp + fn) END) / (CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END), 12) AS f FROM d)"""


@query("choose_operating_thresholds", THRESH + " SELECT (SELECT threshold FROM e ORDER BY f DESC, threshold LIMIT 1) AS macro_f1, coalesce((SELECT threshold FROM e WHERE rc >= 0.9 ORDER BY pr DESC, threshold DESC LIMIT 1), 0.5) AS recall_first, coalesce((SELECT threshold FROM e WHERE pr >= 0.8 ORDER BY rc DESC, threshold LIMIT 1), 0.5) AS precision_first")
def choose_operating_thresholds(spark, sf):
    return E.operating_thresholds(predictions(spark, sf))


@query("operating_point_result", f"WITH {PREDS}, q AS (SELECT y, CASE WHEN score >= 0.3 THEN 1 ELSE 0 END AS p FROM preds), c AS (SELECT {COUNTS} FROM q) SELECT round({R('tp', 'tp + fp')}, 6) AS unreliable_precision, round({R('tp', 'tp + fn')}, 6) AS unreliable_recall, round({F1}, 6) AS unreliable_f1 FROM c")
def operating_point_result(spark, sf):
    p = predictions(spark, sf).withColumn("p", F.when(F.col("score") >= 0.3, 1).otherwise(0))
    return E.classification_metrics(p).select("unreliable_precision", "unreliable_recall", "unreliable_f1")


@query("bootstrap_draws", "SELECT s_suppkey AS grp, r AS replicate, substr(sha1(concat('613|', CAST(r AS VARCHAR), '|', CAST(s_suppkey AS VARCHAR))), 1, 8) AS draw FROM supplier CROSS JOIN (SELECT CAST(unnest(generate_series(0, 4)) AS INTEGER) AS r)")
def bootstrap_draws(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("replicate"))
    return s.withColumn("draw", F.substring(F.sha1(F.concat_ws("|", F.lit("613"), F.col("replicate").cast("string"), F.col("grp").cast("string")).cast("binary")), 1, 8))


# Poisson(1) weights out of a hash, as operators.draws has them
_CUM = []
_term, _total = 0.36787944117144233, 0.0
for _k in range(8):
    _total += _term
    _CUM.append(_total)
    _term /= _k + 1


def draws(replicate: str, unit: str) -> str:
    u = f"(CAST(concat('0x', substr(sha1(concat('613|', CAST({replicate} AS VARCHAR), '|', CAST({unit} AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0e0)"
    return "CASE " + " ".join(f"WHEN {u} < {c!r}e0 THEN {k}" for k, c in enumerate(_CUM)) + " ELSE 8 END"


BOOT = f"""g AS (SELECT grp, {COUNTS} FROM preds GROUP BY 1), d AS (SELECT r, g.*, {draws('r', 'grp')} AS w FROM g CROSS JOIN (SELECT unnest(generate_series(0, 999)) AS r)),
    c AS (SELECT r, sum(tp * w) AS tp, sum(fp * w) AS fp, sum(fn * w) AS fn, sum(tn * w) AS tn FROM d GROUP BY 1),
    m AS (SELECT ({F1} + {F0}) / 2 AS macro_f1, {F1} AS unreliable_f1, {R('tp', 'tp + fn')} AS unreliable_recall, 1.0 * (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c WHERE tp + fp + fn + tn > 0)"""
INTERVAL = "round(avg({0}), 6) AS mean, round(quantile_cont(CAST({0} AS DOUBLE), 0.025), 6) AS low, round(quantile_cont(CAST({0} AS DOUBLE), 0.975), 6) AS high"


@query("bootstrap_intervals", f"WITH {PREDS}, {BOOT} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, {INTERVAL.format(k)} FROM m" for k in ("macro_f1", "unreliable_f1", "unreliable_recall", "accuracy")))
def bootstrap_intervals(spark, sf):
    return E.bootstrap_intervals(predictions(spark, sf), "grp", 1000)


def _side(p: str, of: str) -> str:
    c = lambda y, v: f"count(*) FILTER (WHERE y = {y} AND {p} = {v})"
    return f"{c(1, 1)} AS tp{of}, {c(0, 1)} AS fp{of}, {c(1, 0)} AS fn{of}, {c(0, 0)} AS tn{of}"


def _macro(of: str) -> str:
    f = lambda hit: f"CASE WHEN 2 * {hit}{of} + fp{of} + fn{of} = 0 THEN 0 ELSE 2.0e0 * {hit}{of} / (2 * {hit}{of} + fp{of} + fn{of}) END"
    return f"({f('tp')} + {f('tn')}) / 2"


PAIRED = f"""WITH {KEYED}, g AS (SELECT grp, {_side('pa', '1')}, {_side('pb', '2')} FROM keyed GROUP BY 1), w AS (SELECT r, g.*, {draws('r', 'grp')} AS w FROM g CROSS JOIN (SELECT unnest(generate_series(0, 999)) AS r)),
    c AS (SELECT r, {', '.join(f'sum({x}{k} * w) AS {x}{k}' for x in ('tp', 'fp', 'fn', 'tn') for k in (1, 2))} FROM w GROUP BY 1), d AS (SELECT {_macro('1')} - {_macro('2')} AS d FROM c)"""


@query("paired_bootstrap", f"{PAIRED} SELECT round(avg(d), 6) AS mean, round(quantile_cont(CAST(d AS DOUBLE), 0.025), 6) AS low, round(quantile_cont(CAST(d AS DOUBLE), 0.975), 6) AS high FROM d")
def paired_bootstrap(spark, sf):
    return E.paired_bootstrap(keyed(spark, sf), "grp", 1000)


@query("paired_difference_checked")
def paired_difference_checked(spark, sf):
    from tessera.operators.study import paired_difference

    k = keyed(spark, sf)
    return paired_difference(k.select("record_id", "y", F.col("pa").alias("p")), k.select("record_id", "y", F.col("pb").alias("p")), k, 1000)


RUNS = f"{KEYED}, runs AS (SELECT dataset, CASE WHEN record_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, grp % 3 AS seed, round(avg(score_a - score_b), 6) AS difference FROM keyed GROUP BY 1, 2, 3)"


@query("equivalence_test", f"WITH {RUNS} SELECT dataset, model, count(*) AS runs, string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seeds, round(avg(difference), 5) AS mean_difference, min(difference) AS min_difference, max(difference) AS max_difference, count(*) FILTER (WHERE difference - 0.01 > -0.03 AND difference + 0.01 < 0.03) AS supporting, bool_and(difference - 0.01 > -0.03 AND difference + 0.01 < 0.03) AS all_support FROM runs GROUP BY 1, 2")
def equivalence_test(spark, sf):
    k = keyed(spark, sf).groupBy("dataset", F.when(F.col("record_id") % 2 == 0, "a").otherwise("b").alias("model"), (F.col("grp") % 3).alias("seed")).agg(F.round(F.avg(F.col("score_a") - F.col("score_b")), 6).alias("difference"))
    got = E.equivalence(k.withColumn("low", F.col("difference") - 0.01).withColumn("high", F.col("difference") + 0.01))
    return got.withColumn("mean_difference", F.round("mean_difference", 5))


# ---- shift ----------------------------------------------------------------

SIDES = "sides AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS side, CAST(l_partkey % 17 AS VARCHAR) AS k FROM lineitem)"
SHARES = f"WITH {SIDES}, c AS (SELECT k, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM sides GROUP BY 1), p AS (SELECT k, s, t, 1.0e0 * s / sum(s) OVER () AS ps, 1.0e0 * t / sum(t) OVER () AS pt FROM c)"
JS = "round(sum(0.5 * CASE WHEN ps > 0 THEN ps * log2(ps / ((ps + pt) / 2)) ELSE 0 END + 0.5 * CASE WHEN pt > 0 THEN pt * log2(pt / ((ps + pt) / 2)) ELSE 0 END), 6)"


def sides(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("side"), (F.col("l_partkey") % 17).cast("string").alias("k"), "l_quantity", "l_extendedprice")


@query("js_divergence", SHARES + f" SELECT {JS} AS js FROM p")
def js_divergence(spark, sf):
    return S.with_shares(S.aligned(sides(spark, sf), "k", "side")).agg(F.round(S.js_divergence(), 6).alias("js"))


@query("tv_distance", SHARES + " SELECT round(0.5 * sum(abs(ps - pt)), 6) AS tv FROM p")
def tv_distance(spark, sf):
    return S.with_shares(S.aligned(sides(spark, sf), "k", "side")).agg(F.round(S.tv_distance(), 6).alias("tv"))


@query("ks_statistic", "WITH d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS side, l_quantity AS x FROM lineitem), g AS (SELECT x, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM d GROUP BY 1), c AS (SELECT abs(1.0e0 * sum(s) OVER (ORDER BY x) / sum(s) OVER () - 1.0e0 * sum(t) OVER (ORDER BY x) / sum(t) OVER ()) AS gap FROM g) SELECT round(max(gap), 6) AS ks FROM c")
def ks_statistic(spark, sf):
    d = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("side"), F.col("l_quantity").alias("x"))
    return S.ks_statistic(d, "x", "side").select(F.round("ks", 6).alias("ks"))


@query("smd", "WITH d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS side, l_extendedprice AS x FROM lineitem) SELECT round((avg(x) FILTER (WHERE side = 1) - avg(x) FILTER (WHERE side = 0)) / sqrt(((count(*) FILTER (WHERE side = 0) - 1) * var_samp(x) FILTER (WHERE side = 0) + (count(*) FILTER (WHERE side = 1) - 1) * var_samp(x) FILTER (WHERE side = 1)) / (count(*) - 2)), 6) AS smd FROM d")
def smd(spark, sf):
    return table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("side"), F.col("l_extendedprice").alias("x")).agg(F.round(S.smd("x", "side"), 6).alias("smd"))


@query("length_profile", "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, min(n_chars) AS min, max(n_chars) AS max, round(quantile_cont(n_chars, 0.1), 6) AS p10, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.9), 6) AS p90 FROM documents GROUP BY 1")
def length_profile(spark, sf):
    return S.length_profile(table(spark, sf, "documents"), "n_chars", ["lang"])


@query(
    "categorical_shift",
    SHARES + f""" SELECT count(*) AS categories, count(*) FILTER (WHERE s > 0) AS source_categories, count(*) FILTER (WHERE t > 0) AS target_categories, round(1.0 * count(*) FILTER (WHERE s > 0 AND t > 0) / count(*), 6) AS jaccard,
    round(sum(CASE WHEN s > 0 AND t > 0 THEN pt ELSE 0 END), 6) AS target_overlap_share, round(0.5 * sum(abs(ps - pt)), 6) AS tv, {JS} AS js, round(max(ps), 6) AS source_top1, round(max(pt), 6) AS target_top1,
    round(sum(ps * ps), 6) AS source_hhi, round(sum(pt * pt), 6) AS target_hhi, round(1 / sum(ps * ps), 6) AS source_effective, round(1 / sum(pt * pt), 6) AS target_effective, 0.0 AS target_missing_share FROM p""",
)
def categorical_shift(spark, sf):
    return S.categorical_shift(sides(spark, sf), "k", "side")


VOCAB = "tok AS (SELECT CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS side, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents), c AS (SELECT term, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM tok GROUP BY 1), top AS (SELECT * FROM c ORDER BY s + t DESC, term LIMIT 5000), p AS (SELECT *, 1.0e0 * s / sum(s) OVER () AS ps, 1.0e0 * t / sum(t) OVER () AS pt FROM top)"


def vocab_counts(spark, sf):
    from tessera.functions.text import tokens

    d = table(spark, sf, "documents").select(F.when(F.col("lang") == "en", 0).otherwise(1).alias("side"), "text")
    return S.vocabulary(d, tokens(F.col("text")), "side")


@query("vocab_shift", f"WITH {VOCAB} SELECT count(*) AS terms, count(*) FILTER (WHERE s >= 1) AS source_terms, count(*) FILTER (WHERE t >= 1) AS target_terms, round(1.0 * count(*) FILTER (WHERE s >= 1 AND t >= 1) / count(*) FILTER (WHERE s >= 1 OR t >= 1), 6) AS jaccard, round(1.0 * sum(t) FILTER (WHERE s >= 1) / sum(t), 6) AS target_token_coverage, {JS} AS js FROM p")
def vocab_shift(spark, sf):
    return S.vocab_shift(vocab_counts(spark, sf))


@query("topk_terms_delta", f"WITH {VOCAB} SELECT term, s, t, round(round(pt - ps, 9), 6) AS delta FROM p ORDER BY round(pt - ps, 9) DESC, term LIMIT 20")
def topk_terms_delta(spark, sf):
    return S.enriched_terms(vocab_counts(spark, sf), 20).drop("log2_ratio")


@query("topic_mix", "WITH d AS (SELECT vec_id, CASE WHEN label < 5 THEN 0 ELSE 1 END AS side, list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0.0)) AS w FROM embeddings), n AS (SELECT side, count(*) AS n FROM d GROUP BY 1), l AS (SELECT side, unnest(generate_series(0, 63)) AS topic, unnest(list_transform(w, lambda x: x / list_sum(w))) AS v FROM d WHERE list_sum(w) > 0) SELECT l.side, CAST(l.topic AS INTEGER) AS topic, round(sum(l.v) / max(n.n), 5) AS share FROM l JOIN n ON l.side = n.side GROUP BY 1, 2")
def topic_mix(spark, sf):
    e = table(spark, sf, "embeddings").select(F.when(F.col("label") < 5, 0).otherwise(1).alias("side"), "embedding")
    return S.topic_mix(e, "embedding", "side")


@query("domain_exclusion", "WITH t AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'), s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') SELECT count(*) AS n, count(s.o_custkey) AS removed, count(*) - count(s.o_custkey) AS remaining, round(1.0 * count(s.o_custkey) / count(*), 6) AS removed_share FROM t LEFT JOIN s ON t.o_custkey = s.o_custkey")
def domain_exclusion(spark, sf):
    o = table(spark, sf, "orders").withColumn("k", F.col("o_custkey").cast("string"))
    return S.domain_exclusion(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'"), "k")


@query("shift_summary_long", SHARES + f" SELECT 'category' AS dimension, 'tv' AS metric, round(0.5 * sum(abs(ps - pt)), 6) AS value FROM p UNION ALL SELECT 'category', 'js', {JS} FROM p")
def shift_summary_long(spark, sf):
    got = S.categorical_shift(sides(spark, sf), "k", "side").select(F.lit("category").alias("dimension"), "tv", "js")
    return got.unpivot(["dimension"], ["tv", "js"], "metric", "value")


@query("length_shift", f"WITH {ITEMS} SELECT round(avg(n_chars) FILTER (WHERE dataset <> 'en') / avg(n_chars) FILTER (WHERE dataset = 'en'), 6) AS mean_ratio, round(median(n_chars) FILTER (WHERE dataset <> 'en') / median(n_chars) FILTER (WHERE dataset = 'en'), 6) AS median_ratio FROM items")
def length_shift(spark, sf):
    s, t = F.when(F.col("dataset") == "en", F.col("n_chars")), F.when(F.col("dataset") != "en", F.col("n_chars"))
    return items(spark, sf).agg(F.round(F.avg(t) / F.avg(s), 6).alias("mean_ratio"), F.round(F.percentile(t, 0.5) / F.percentile(s, 0.5), 6).alias("median_ratio"))


@query("sort_stable_tiebreak", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey")
def sort_stable_tiebreak(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").orderBy("o_orderpriority", "o_orderkey")


@query("agg_equivalence", f"WITH {RUNS} SELECT dataset, model, count(*) AS runs, count(*) FILTER (WHERE abs(difference) < 0.03) AS supporting FROM runs GROUP BY 1, 2")
def agg_equivalence(spark, sf):
    k = keyed(spark, sf).groupBy("dataset", F.when(F.col("record_id") % 2 == 0, "a").otherwise("b").alias("model"), (F.col("grp") % 3).alias("seed")).agg(F.round(F.avg(F.col("score_a") - F.col("score_b")), 6).alias("difference"))
    return E.equivalence(k.withColumn("low", F.col("difference")).withColumn("high", F.col("difference"))).select("dataset", "model", "runs", "supporting")


@query("rating3_sensitivity", f"WITH {KEYED}, q AS (SELECT y, pa, pb FROM keyed WHERE dataset <> '3-MEDIUM'), a AS (SELECT avg(CASE WHEN y = pa THEN 1.0e0 ELSE 0 END) AS x, avg(CASE WHEN y = pb THEN 1.0e0 ELSE 0 END) AS z, count(*) AS n FROM q) SELECT n, round(x, 6) AS primary_accuracy, round(z, 6) AS retrained_accuracy FROM a")
def rating3_sensitivity(spark, sf):
    k = keyed(spark, sf).where("dataset <> '3-MEDIUM'")
    right = lambda c: F.round(F.avg((F.col("y") == F.col(c)).cast("double")), 6)
    return k.agg(F.count("*").alias("n"), right("pa").alias("primary_accuracy"), right("pb").alias("retrained_accuracy"))
