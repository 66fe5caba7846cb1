"""Gates that turn reviewed narrative and audit sheets into results.

People fill the ``human_*`` and ``stage_*`` columns; nothing here guesses
them. Every finisher returns its issues as (gate, detail) rows, and results
only where there is none. Sheets are as long as the roster that was reviewed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import descriptor_signature, normalized_enum
from tessera.operators.relational import key_difference
from tessera.operators.review import AWAITING, COMPLETED, code_summary

ISSUE = "gate string, detail string"

# What a reviewer may enter, and the fields of the audit sheets.
COHERENCE = ("coherent", "mixed", "incoherent")
SUPPORT = ("yes", "no", "unclear")
STANCE = ("endorsement", "discussion", "debunking", "mixed", "unclear")
ARTIFACT = ("none", "publisher", "dataset", "generic", "mixed", "unclear")
AUDIT_VERSION = "single_reviewer_two_stage_v1"
AUDIT_META = ("audit_protocol_version", "audit_roster_sha256")
AUDIT_SIGNALS = ("stage_a_health_relevant_signal", "stage_a_source_or_dataset_artifact", "stage_a_label_ambiguity")
AUDIT_STANCE = (*STANCE, "not_applicable")
AUDIT_REVEALED = ("record_id", "selection_reason", "harmonized_label", "anchor_prediction", "anchor_outcome")
AUDIT_ERRORS = (
    "no_model_error",
    "source_or_publisher_artifact",
    "topic_shortcut",
    "temporal_or_event_specific_cue",
    "label_ambiguity",
    "text_unit_mismatch",
    "insufficient_context",
    "discussion_or_debunking_mistaken_for_endorsement",
    "medical_terminology_misunderstanding",
    "sensational_or_emotional_framing",
    "truncation_or_preprocessing_failure",
    "engagement_proxy_or_missingness_artifact",
    "unexplained_residual_error",
)

TOPIC = ["dataset", "topic_id"]
PLACE = [*TOPIC, "record_id", "representative_rank"]


def _plain(c: Column | str) -> Column:
    return F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))


def _name(keys: list[str]) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


def _rows(df: DataFrame, gate: str, detail: Column) -> DataFrame:
    return df.select(F.lit(gate).alias("gate"), detail.alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _lacking(spark, frames: dict[str, tuple[DataFrame, set[str]]]) -> list[tuple[str, str]]:
    return [("schema", f"{label} lacks {', '.join(sorted(need - set(df.columns)))}") for label, (df, need) in frames.items() if need - set(df.columns)]


def _typed(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Keys in one form, and rows whose topic, rank or record cannot be read."""
    whole = ["topic_id", *(["representative_rank"] if "representative_rank" in df.columns else [])]
    as_number = {c: F.expr(f"try_cast(trim(cast({c} AS string)) AS double)") for c in whole}
    bad = [df.where(n.isNull() | (n % 1 != 0)) for n in as_number.values()]
    out = df.withColumns({"dataset": _plain("dataset"), **{c: n.cast("long") for c, n in as_number.items()}})
    if "record_id" in df.columns:
        out = out.withColumn("record_id", _plain("record_id"))
        bad.append(out.where("record_id = ''").select(*df.columns))
    return out, _union([_rows(b, "key", F.lit(label)) for b in bad]).distinct()


def _repeated(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    return _rows(df.groupBy(*keys).count().where("count > 1"), f"repeated in {label}", _name(keys))


def _frozen(sheet: DataFrame, origin: DataFrame, keys: list[str], columns: list[str], label: str) -> DataFrame:
    """Ids that only one side has, and rows whose printed context was changed."""
    parts = [_rows(key_difference(a, b, keys), f"{label}: {what}", _name(keys)) for a, b, what in ((sheet, origin, "unknown row"), (origin, sheet, "missing row"))]
    absent = sorted(set(columns) - set(sheet.columns))
    if absent:
        parts.append(sheet.sparkSession.createDataFrame([(f"{label}: context", f"lacks {', '.join(absent)}")], ISSUE))
    rest = [c for c in columns if c not in keys and c not in absent]
    if rest:
        text = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit(""))
        other = reduce(lambda x, y: x | y, [text("s", c) != text("o", c) for c in rest])
        parts.append(_rows(sheet.alias("s").join(origin.alias("o"), keys).where(other).select(*keys), f"{label}: context", _name(keys)))
    return _union(parts)


def _entered(df: DataFrame, c: str) -> Column:
    return normalized_enum(F.col(c)) if c in df.columns else F.lit("")


def _outcomes(eligible: DataFrame, topics: DataFrame, shown: DataFrame, confirmed: str) -> DataFrame:
    """One row per eligible topic: what was entered and how many representatives were reviewed."""
    said = lambda c: _entered(shown, c)
    valid = said("human_supports_topic").isin(*SUPPORT) & said("human_stance").isin(*STANCE) & said("human_artifact_pattern").isin(*ARTIFACT) & (said("human_review_confirmation") == confirmed)
    seen = shown.groupBy(*TOPIC).agg(F.count_if(valid).alias("representatives_reviewed"), F.count_if(valid & (said("human_supports_topic") == "yes")).alias("representatives_supporting"))
    words = lambda c: _plain(c) if c in topics.columns else F.lit("")
    own = topics.select(
        *TOPIC,
        *[_entered(topics, c).alias(c) for c in ("human_topic_coherence", "human_topic_stance", "human_artifact_pattern", "human_review_confirmation", "human_label_source")],
        words("human_narrative_id").alias("final_narrative_id"),
        words("human_narrative_label").alias("candidate_narrative_label"),
        descriptor_signature(words("human_narrative_label")).isin(*[descriptor_signature(words(c)) for c in ("machine_topic_name", "machine_topic_keywords")]).alias("_machine"),
    )
    counts = F.col("records").cast("long").alias("records")
    return eligible.select(*TOPIC, counts).join(own, TOPIC).join(seen, TOPIC, "left").fillna(0, ["representatives_reviewed", "representatives_supporting"])


def _topic_issues(t: DataFrame, least: int, confirmed: str) -> DataFrame:
    sound = (F.col("human_topic_coherence") == "coherent") & (F.col("human_artifact_pattern") == "none")
    gates = {
        "coherence": ~F.col("human_topic_coherence").isin(*COHERENCE),
        "stance": ~F.col("human_topic_stance").isin(*STANCE),
        "artifact": ~F.col("human_artifact_pattern").isin(*ARTIFACT),
        "confirmation": F.col("human_review_confirmation") != confirmed,
        "narrative id": sound & (F.col("final_narrative_id") == ""),
        "label": sound & (F.col("candidate_narrative_label") == ""),
        "label source": sound & (F.col("human_label_source") != "reviewer_authored"),
        "machine label": sound & F.col("_machine"),
        "representatives": F.col("representatives_reviewed") < least,
    }
    failed = F.filter(F.array(*[F.when(bad, g) for g, bad in gates.items()]), lambda g: g.isNotNull())
    return t.select(F.explode(failed).alias("gate"), _name(TOPIC).alias("detail"))


def finalize_narratives(candidates: DataFrame, topics: DataFrame, shown: DataFrame, expected: DataFrame, *, least_documents: int = 30, least_representatives: int = 5, confirmation: str = "human_reviewed") -> tuple[str, DataFrame, DataFrame | None, DataFrame | None, DataFrame | None]:
    """(status, issues, narratives, topic mapping, topic outcomes) of one reviewer's sheets.

    ``candidates`` are all topics (``eligible_topic_size`` marks those that
    were reviewed), ``topics`` the reviewed topic sheet, ``shown`` the reviewed
    representatives and ``expected`` those that were printed. Null entries are
    blank. Topics with one narrative id merge if their labels agree; a
    narrative is retained with enough documents and supporting representatives.
    """
    confirmed = confirmation.strip().lower()
    if not confirmed:
        raise ValueError("confirmation must not be blank")
    spark = candidates.sparkSession
    frames = {"candidates": (candidates, {*TOPIC, "records", "eligible_topic_size"}), "topic review": (topics, set(TOPIC)), "representative review": (shown, set(PLACE)), "expected representatives": (expected, set(PLACE))}
    lacking = _lacking(spark, frames)
    if lacking:
        return AWAITING, spark.createDataFrame(lacking, ISSUE), None, None, None
    typed = [_typed(df, label) for label, (df, _) in frames.items()]
    issues = _union([bad for _, bad in typed])
    if not issues.isEmpty():
        return AWAITING, issues, None, None, None
    candidates, topics, shown, expected = (df for df, _ in typed)
    eligible = candidates.where(normalized_enum(F.col("eligible_topic_size")).isin("true", "yes", "1"))
    row = [*TOPIC, "record_id"]
    issues = _union(
        [
            _repeated(topics, TOPIC, "topic review"),
            _repeated(shown, row, "representative review"),
            _repeated(expected, row, "expected representatives"),
            _frozen(topics, eligible, TOPIC, candidates.columns, "topic review"),
            _frozen(shown, expected, PLACE, [c for c in expected.columns if not c.startswith("human_")], "representative review"),
        ]
    )
    if not issues.isEmpty():
        return AWAITING, issues, None, None, None
    outcomes = _outcomes(eligible, topics, shown, confirmed)
    issues = _topic_issues(outcomes, least_representatives, confirmed)
    outcomes = outcomes.drop("_machine", "human_review_confirmation", "human_label_source")
    if not issues.isEmpty():
        return AWAITING, issues, None, None, outcomes
    sound = outcomes.where("human_topic_coherence = 'coherent' AND human_artifact_pattern = 'none'")
    merged = sound.groupBy("dataset", "final_narrative_id").agg(
        F.count_distinct("candidate_narrative_label").alias("labels"),
        F.min("candidate_narrative_label").alias("candidate_narrative_label"),
        F.sum("records").alias("records"),
        F.array_join(F.sort_array(F.collect_list("topic_id")), "|").alias("topics"),  # topics that a person reviewed
        F.sum("representatives_reviewed").alias("representatives_reviewed"),
        F.sum("representatives_supporting").alias("representatives_supporting"),
    )
    issues = _rows(merged.where("labels > 1"), "merged labels", _name(["dataset", "final_narrative_id"]))
    if not issues.isEmpty():
        return AWAITING, issues, None, None, outcomes
    reason = F.when(F.col("records") < least_documents, "fewer_than_minimum_documents").when(F.col("representatives_supporting") < least_representatives, "fewer_than_minimum_supporting_representatives").otherwise("retained_after_human_validation")
    narratives = merged.drop("labels").withColumn("retention_reason", reason).withColumn("retained", F.col("retention_reason") == "retained_after_human_validation")
    mapping = sound.select(*TOPIC, "final_narrative_id", "candidate_narrative_label").join(narratives.where("retained").select("dataset", "final_narrative_id"), ["dataset", "final_narrative_id"], "left_semi")
    why = (
        F.when(F.col("retained"), "retained_after_human_validation")
        .when(F.col("human_artifact_pattern") != "none", F.concat(F.lit("rejected_"), "human_artifact_pattern", F.lit("_artifact_pattern")))
        .when(F.col("human_topic_coherence") != "coherent", F.concat(F.lit("rejected_"), "human_topic_coherence"))
        .otherwise("rejected_by_narrative_retention_gate")
    )
    kept = mapping.select(*TOPIC, F.lit(True).alias("retained"))
    outcomes = outcomes.join(kept, TOPIC, "left").fillna(False, ["retained"]).withColumn("retention_reason", why)
    return COMPLETED, issues, narratives, mapping, outcomes


def _one_value(sheet: DataFrame, c: str, label: str) -> DataFrame:
    got = sheet.agg(F.count_distinct(normalized_enum(F.col(c))).alias("n"), F.count_if(normalized_enum(F.col(c)) == "").alias("blank"))
    return _rows(got.where("n <> 1 OR blank > 0"), "metadata", F.lit(f"{label}: {c}"))


def finalize_audit(stage_a: DataFrame, stage_b: DataFrame, template: DataFrame, version: str = AUDIT_VERSION) -> tuple[str, DataFrame, DataFrame | None, DataFrame | None]:
    """(status, issues, cases, code summary) of the blinded and the revealed stage of an audit.

    Both stages must hold the template's cases, its context unchanged, one
    protocol version and roster hash, and a valid code in every coding field.
    An empty sheet is an issue.
    """
    spark = stage_a.sparkSession
    codes = {
        "stage A": ({**dict.fromkeys(AUDIT_SIGNALS, SUPPORT), "stage_a_stance": AUDIT_STANCE, "stage_a_notes": None}, set()),
        "stage B": ({"stage_b_error_code": AUDIT_ERRORS, "stage_b_review_notes": None}, set(AUDIT_REVEALED)),
    }
    need = {label: {"case_id", *AUDIT_META, *fields, *more} for label, (fields, more) in codes.items()}
    lacking = _lacking(spark, {"stage A": (stage_a, need["stage A"]), "stage B": (stage_b, need["stage B"]), "template": (template, need["stage A"] | need["stage B"])})
    if lacking:
        return AWAITING, spark.createDataFrame(lacking, ISSUE), None, None
    sheets = {"stage A": stage_a, "stage B": stage_b, "template": template}
    sheets = {k: df.withColumn("case_id", _plain("case_id")) for k, df in sheets.items()}
    frozen, coding = sheets["template"], {c for fields, _ in codes.values() for c in fields}
    parts = []
    for label, df in sheets.items():
        parts += [_repeated(df, ["case_id"], label), _rows(df.where("case_id = ''"), "blank case_id", F.lit(label)), _rows(df.agg(F.count("*").alias("n")).where("n = 0"), "no cases", F.lit(label))]
    for label, (fields, _) in codes.items():
        df = sheets[label]
        parts += [_one_value(df, c, label) for c in AUDIT_META]
        context = [c for c in df.columns if c not in coding]
        unknown = [c for c in context if c not in frozen.columns]
        if unknown:
            parts.append(spark.createDataFrame([("context", f"{label}: {', '.join(unknown)} not in the template")], ISSUE))
        parts.append(_frozen(df, frozen, ["case_id"], [c for c in context if c in frozen.columns], label))
        for c, allowed in fields.items():
            v = normalized_enum(F.col(c))
            wrong = v == "" if allowed is None else ~v.isin(*allowed)
            parts.append(df.where(wrong).select(F.when(v == "", "blank").otherwise("vocabulary").alias("gate"), F.concat_ws(":", "case_id", F.lit(c)).alias("detail")))
    a, b = sheets["stage A"], sheets["stage B"]
    parts.append(_rows(a.where(normalized_enum(F.col(AUDIT_META[0])) != version.lower()), "protocol version", _name(["case_id"])))
    for c in AUDIT_META:
        pair = a.agg(F.min(normalized_enum(F.col(c))).alias("x")).join(b.agg(F.min(normalized_enum(F.col(c))).alias("y")))  # one row each
        parts.append(_rows(pair.where("x <> y"), "stages differ", F.lit(c)))
    issues = _union(parts)
    if not issues.isEmpty():
        return AWAITING, issues, None, None
    tidy = {c: (normalized_enum(F.col(c)) if allowed else _plain(c)) for fields, _ in codes.values() for c, allowed in fields.items()}
    a = a.withColumns({c: tidy[c] for c in codes["stage A"][0]})
    b = b.withColumns({c: tidy[c] for c in codes["stage B"][0]})
    shared = [c for c in a.columns if c in b.columns and c != "case_id"]
    cases = a.withColumnsRenamed({c: f"{c}_stage_a_context" for c in shared}).join(b, "case_id")
    return COMPLETED, issues, cases, code_summary(cases, [*AUDIT_SIGNALS, "stage_a_stance", "stage_b_error_code"])
