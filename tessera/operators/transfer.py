"""Transfer between datasets against in-domain baselines, with coded reasons where no comparison is possible."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.evaluation import classification_metrics, ranking_metrics
from tessera.operators.relational import duplicate_keys, key_difference

METRICS = ("macro_f1", "unreliable_f1", "unreliable_recall", "pr_auc")
SAME, STANDARD = "target_in_domain_same_records", "source_in_domain_standard_test"
#: (text representation, model) to (baseline model, text column); None where the baseline matrix has no such cell.
BASELINES = {
    ("full_text", "logistic_regression"): ("logistic_regression", "model_text"),
    ("full_text", "linear_svm"): ("linear_svm", "model_text"),
    ("title_only", "logistic_regression"): ("title_only_logistic", "title"),
    ("title_only", "linear_svm"): None,
}


@dataclass(frozen=True)
class Comparator:
    """The one baseline that a transfer run is compared with."""

    kind: str
    dataset: str
    model: str | None
    column: str | None
    reason: str

    @property
    def same_records(self) -> bool:
        return self.kind == SAME

    @property
    def experiment_id(self) -> str | None:
        return f"{self.dataset}_standard_{self.model}_{self.column}" if self.model else None

    def config(self) -> dict:
        return {"experiment_id": self.experiment_id, "dataset": self.dataset, "split_name": "standard", "model": self.model, "text_column": self.column}


def comparator_spec(source: str, target: str, representation: str, model: str, kind: str) -> Comparator:
    if kind not in (SAME, STANDARD):
        raise ValueError(f"unknown comparator kind {kind}")
    dataset = target if kind == SAME else source
    if representation not in {r for r, _ in BASELINES}:
        return Comparator(kind, dataset, None, None, "unsupported_text_representation")
    if (representation, model) not in BASELINES:
        return Comparator(kind, dataset, None, None, "unsupported_transfer_model")
    cell = BASELINES[representation, model]
    if cell is None:
        return Comparator(kind, dataset, None, None, "same_family_title_only_baseline_not_in_baseline_matrix")
    return Comparator(kind, dataset, *cell, "")


def metric_bag(preds: DataFrame) -> dict[str, float | None]:
    """The compared metrics of (y, p, score) predictions; pr_auc is None without scores or a class."""
    m = classification_metrics(preds).first().asDict()
    if "score" in preds.columns:
        m |= ranking_metrics(preds).first().asDict()
    return {k: m.get(k) for k in METRICS}


def _gate(transfer: DataFrame, spec: Comparator, summary: DataFrame | None, config: dict | None, baseline: DataFrame | None):
    """(reason, summary row): the first gate that fails, or ''."""
    need = {"record_id", "y", "p"}
    if spec.reason:
        return spec.reason, None
    if summary is None or summary.isEmpty():
        return "latest_baseline_summary_unavailable", None
    if not {"experiment_id", "n", *METRICS} <= set(summary.columns):
        return "latest_baseline_summary_schema_incompatible", None
    rows = summary.where(F.col("experiment_id") == spec.experiment_id).limit(2).collect()
    if len(rows) != 1:
        return ("duplicate_exact_baseline_experiment_in_latest_summary" if rows else "exact_baseline_experiment_missing_from_latest_summary"), None
    row = rows[0]
    if config is None:
        return "baseline_config_unavailable", row
    wrong = sorted(k for k, v in spec.config().items() if config.get(k) != v)
    if wrong:
        return "baseline_config_mismatch:" + ",".join(wrong), row
    if not need <= set(transfer.columns):
        return "transfer_prediction_schema_incompatible", row
    if not duplicate_keys(transfer, ["record_id"]).isEmpty():
        return "duplicate_transfer_prediction_record_ids", row
    if not spec.same_records:
        return "", row
    if baseline is None:
        return "baseline_predictions_unavailable", row
    if not need <= set(baseline.columns):
        return "baseline_prediction_schema_incompatible", row
    if not duplicate_keys(baseline, ["record_id"]).isEmpty():
        return "duplicate_baseline_prediction_record_ids", row
    if not key_difference(transfer, baseline, ["record_id"]).isEmpty():
        return "baseline_predictions_do_not_cover_transfer_record_set", row
    j = transfer.select("record_id", "y").join(baseline.select("record_id", F.col("y").alias("yb")), "record_id")
    if not j.where("y <> yb").isEmpty():
        return "label_mismatch_on_like_for_like_record_set", row
    return "", row


def _metric_reason(metric: str, own: float | None, base: float | None, spec: Comparator, both: bool, transfer: DataFrame, baseline: DataFrame | None) -> str:
    auc = metric == "pr_auc"
    if base is None:
        if auc and spec.same_records and not both:
            return "like_for_like_subset_lacks_both_classes_for_pr_auc"
        if auc and baseline is not None and "score" not in baseline.columns:
            return "baseline_score_unavailable_for_pr_auc"
        return "in_domain_metric_unavailable"
    if own is None:
        if auc and not both:
            return "transfer_subset_lacks_both_classes_for_pr_auc"
        if auc and "score" not in transfer.columns:
            return "transfer_score_unavailable_for_pr_auc"
        return "transfer_metric_unavailable"
    return ""


def degradation(transfer: DataFrame, spec: Comparator, summary: DataFrame | None, config: dict | None, baseline: DataFrame | None = None) -> DataFrame:
    """One row per metric: comparator and transfer values, their difference, or why there is none."""
    spark = transfer.sparkSession
    reason, row = _gate(transfer, spec, summary, config, baseline)
    out = []
    own = base = dict.fromkeys(METRICS)
    both = False
    if not reason:
        own = metric_bag(transfer)
        both = transfer.select("y").distinct().count() == 2
        base = metric_bag(baseline.join(transfer.select("record_id"), "record_id", "left_semi")) if spec.same_records else {m: row[m] for m in METRICS}
    for m in METRICS:
        why = reason or _metric_reason(m, own[m], base[m], spec, both, transfer, baseline)
        a, b = base[m], own[m]
        delta = None if why else b - a
        relative = None if why or a == 0 else delta / a
        out.append((spec.kind, spec.experiment_id or "", m, "unavailable" if why else "available", why, a, b, delta, relative, why or ("" if a else "zero_in_domain_comparator_metric")))
    return spark.createDataFrame(out, "comparator_kind string, baseline_experiment_id string, metric string, status string, unavailable_reason string, in_domain double, transfer double, delta double, relative_delta double, relative_reason string")
