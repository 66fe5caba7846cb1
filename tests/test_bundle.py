"""The shift bundle: thirteen tables, and what is written of them."""

import json

import pytest

from tessera.operators.bundle import REQUIRED, shift_bundle
from tessera.operators.relational import ContractError
from tessera.sources import sinks

SCHEMA = "record_id string, harmonized_label string, text_unit string, publisher_id string, source_domain string, model_text string, title string"
SOURCE = [
    ("s1", "reliable", "article", "p1", "shared.org", "vaccine trial shows safe results for children", "vaccine trial"),
    ("s2", "unreliable", "article", "p2", "a.org", "miracle cure doctors hate vaccine", "miracle cure"),
    ("s3", "reliable", "claim", "p1", "", "vaccine works", None),
    ("s4", "reliable", "article", "p3", "a.org", "children vaccine trial results", "trial results"),
]
TARGET = [
    ("t1", "unreliable", "article", "p9", "t.org", "miracle cure market crash vaccine", "miracle market"),
    ("t2", "reliable", "article", None, "shared.org", "left out", "left out"),
    ("t3", "reliable", "article", "p1", "  ", "market prices fall children", "market prices"),
]


@pytest.fixture(scope="module")
def bundle(spark):
    s, t = (spark.createDataFrame(rows, SCHEMA) for rows in (SOURCE, TARGET))
    return shift_bundle(s, t, s, source_name="one", target_name="two", topics=2, topic_rounds=3, enriched=3)


def test_tables(bundle):
    assert len(bundle) == 13
    p = {r.cohort: r for r in bundle["cohort_profiles"].collect()}
    assert [p[c].records for c in ("source_train", "target_test_before_domain_exclusion", "target_test_after_domain_exclusion")] == [4, 3, 2]
    assert p["source_train"].unreliable_prevalence == 0.25 and p["source_train"].source_domains == 3 and p["target_test_after_domain_exclusion"].publishers == 2
    x = bundle["domain_exclusion_summary"].first()
    assert (x.source_domain_reference_count, x.target_records_removed, x.target_domains_removed, x.remaining_target_records_on_exclusion_domains) == (2, 1, 1, 0)
    v = {r.text_representation: r for r in bundle["vocabulary_summary"].collect()}["full_text"]
    # vaccine 4, trial 2, results 2, children 2 in the source; market 2 in the target
    assert (v.source_active_types, v.target_active_types, v.shared_active_types, v.active_type_jaccard) == (4, 1, 0, 0.0)
    terms = bundle["vocabulary_shift_terms"].where("text_representation = 'full_text' AND rank = 1").collect()
    assert {r.enrichment: r.term for r in terms} == {"source_enriched": "results", "target_enriched": "market"}
    n = {(r.text_representation, r.cohort): r for r in bundle["document_length_profiles"].collect()}
    assert n["title_only", "source_train"].empty_document_share == 0.25 and n["full_text", "source_train"].median_tokens == 4.5
    shift = {r.text_representation: r for r in bundle["document_length_shift"].collect()}["full_text"]
    assert shift.target_minus_source_mean_tokens == pytest.approx(4.5 - 18 / 4) and 0 <= shift.kolmogorov_smirnov_statistic <= 1
    c = {r.field: r for r in bundle["categorical_shift_summary"].collect()}
    assert c["harmonized_label"].target_minus_source_unreliable_prevalence == 0.25 and c["text_unit"].source_unreliable_prevalence is None and c["publisher_id"].category_jaccard == 0.25
    assert c["source_domain"].source_missing_share == 0.25 and c["source_domain"].target_missing_share == 0.5
    t = bundle["topic_proxy_distributions"].collect()
    assert {r.topic_id for r in t} == {"topic_00", "topic_01", "unassigned"} and sum(r.mean_weight_share for r in t) == pytest.approx(2, abs=1e-5)
    assert bundle["topic_proxy_assignments"].count() == 6 and bundle["topic_proxy_summary"].first().fitted_topics == 2
    s = {(r.dimension, r.component, r.metric): r.value for r in bundle["shift_summary"].collect()}
    assert s["domain_exclusion", "source_domain", "target_records_removed"] == 1 and s["composition", "harmonized_label", "target_minus_source_unreliable_prevalence"] == 0.25
    assert len(s) == 2 * 4 + 2 * 4 + 4 * 4 + 1 + 4 + 3


def test_written_bundle(spark, bundle, tmp_path):
    sinks.write_bundle(bundle, str(tmp_path / "b"))
    got = json.loads((tmp_path / "b" / "summary.json").read_text())
    assert got["direction"] == "one_to_two" and len(got["tables"]) == 13 and len(got["summaries"]["cohort_profiles"]) == 3
    text = (tmp_path / "b" / "summary.md").read_text()
    assert text.startswith("# Shift from one to two") and "## Composition" in text and "NA" in text
    assert spark.read.parquet(str(tmp_path / "b" / "categorical_distributions")).count() == bundle["categorical_distributions"].count()


def test_contracts(spark):
    s, t = (spark.createDataFrame(rows, SCHEMA) for rows in (SOURCE, TARGET))
    with pytest.raises(ContractError, match="title"):
        shift_bundle(s.drop("title"), t, s, source_name="a", target_name="b")
    with pytest.raises(ContractError, match="must hold records"):
        shift_bundle(s, t.where("source_domain = 'shared.org'"), s, source_name="a", target_name="b")
    assert set(REQUIRED) == set(s.columns)
