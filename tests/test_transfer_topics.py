import pytest

from tessera.operators import provenance as V
from tessera.operators import transfer as T
from tessera.operators.topics import topic_proxy

SUMMARY = "experiment_id string, n int, macro_f1 double, unreliable_f1 double, unreliable_recall double, pr_auc double"


def test_degradation(spark):
    spec = T.comparator_spec("a", "b", "full_text", "logistic_regression", T.SAME)
    summary = spark.createDataFrame([(spec.experiment_id, 3, 1.0, 1.0, 1.0, 1.0)], SUMMARY)
    own = spark.createDataFrame([("1", 0, 0, 0.2), ("2", 1, 0, 0.1)], "record_id string, y int, p int, score double")
    base = spark.createDataFrame([("1", 0, 0, 0.1), ("2", 1, 1, 0.9), ("3", 1, 1, 0.9)], "record_id string, y int, p int, score double")
    got = {r.metric: r for r in T.degradation(own, spec, summary, spec.config(), base).collect()}
    assert got["macro_f1"].delta == pytest.approx(-2 / 3, abs=1e-5) and got["pr_auc"].transfer == 0.5 and got["pr_auc"].in_domain == 1.0

    def why(*args):
        return {r.unavailable_reason for r in T.degradation(*args).collect()}

    assert why(own, spec, None, None) == {"latest_baseline_summary_unavailable"}
    assert why(own, spec, summary.where("n > 5"), None) == {"latest_baseline_summary_unavailable"}
    assert why(own, spec, summary, None) == {"baseline_config_unavailable"}
    assert why(own, spec, summary, spec.config() | {"model": "x"}) == {"baseline_config_mismatch:model"}
    assert why(own, spec, summary, spec.config()) == {"baseline_predictions_unavailable"}
    assert why(own.union(own), spec, summary, spec.config()) == {"duplicate_transfer_prediction_record_ids"}
    assert why(own, spec, summary, spec.config(), base.where("record_id = '1'")) == {"baseline_predictions_do_not_cover_transfer_record_set"}
    assert T.comparator_spec("a", "b", "title_only", "linear_svm", T.STANDARD).reason.startswith("same_family")


def test_topics(spark):
    texts = ["vaccine virus infection doctor"] * 6 + ["football match stadium goal"] * 6
    df = spark.createDataFrame([(f"r{i}", i // 6, t) for i, t in enumerate(texts)] + [("e", 1, "")], "record_id string, side int, text string")
    mix, terms = topic_proxy(df, "side", topics=2)
    w = {r.record_id: r.weights for r in mix.collect()}
    top = {k: max(range(2), key=lambda j: v[j]) for k, v in w.items() if sum(v) > 0}
    assert len({top[f"r{i}"] for i in range(6)}) == 1 and top["r0"] != top["r7"] and sum(w["e"]) == 0
    assert terms.count() > 0


def test_provenance(spark):
    df = spark.createDataFrame([("b", None), ("a", 1)], "k string, v int")
    assert V.roster_hash(df, ["k"]) == V.roster_hash(df.orderBy("k"), ["k"]) != V.roster_hash(df.na.fill(2), ["k"])
    assert V.status_row(spark, "s", "awaiting_human_validation").first().exit_code == 3
    with pytest.raises(ValueError):
        V.status_row(spark, "s", "odd")
    assert len(V.encoder_plan([("a", "standard"), ("b", "standard"), ("b", "temporal")], ["m", "n"], [1, 2, 3])) == 18
    assert V.code_revision("/")["revision"] == ""
