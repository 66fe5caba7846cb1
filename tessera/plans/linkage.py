"""Linkage, splits and samplers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import linkage as L
from tessera.operators import splits as P
from tessera.plans.adapters import ASSIGNMENTS, ITEMS, KEYED, PAGE_RECORDS, TITLES, ampersand_titles, assignments, cleaned_pages, items, keyed, table
from tessera.plans.registry import query
from tessera.runtime import Workspace

NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
KEYS = f"""{PAGE_RECORDS}, r AS (SELECT CAST(page_id AS VARCHAR) AS record_id, u, t, b, w FROM pr),
    keys AS (SELECT record_id, concat('url:', u) AS key FROM r WHERE u <> '' UNION SELECT record_id, concat('title:', substr(sha1(t), 1, 16)) FROM r WHERE length(t) >= 20 AND len(string_split(t, ' ')) >= 6
        UNION SELECT record_id, concat('body:', substr(sha1(b), 1, 16)) FROM r WHERE len(string_split(b, ' ')) >= 30 UNION SELECT record_id, concat('text:', substr(sha1(w), 1, 16)) FROM r WHERE w <> '')"""


def records(spark, sf):
    """Pages as records; they name no other addresses."""
    p = cleaned_pages(spark, sf)
    return p.select(F.lit("pages").alias("dataset"), F.col("page_id").cast("string").alias("record_id"), "url", F.lit("[]").alias("alternate_urls"), "title", F.col("body").alias("body_text"), "model_text")


@query("family_exact_keys", f"WITH {KEYS} SELECT record_id, key FROM keys")
def family_exact_keys(spark, sf):
    return L.exact_keys(records(spark, sf)).select("record_id", "key")


_GRAMS = " UNION ALL ".join(f"SELECT id, times, substr(w, i, {n}) AS g FROM (SELECT id, times, w, unnest(generate_series(1, length(w) - {n - 1})) AS i FROM words WHERE length(w) >= {n})" for n in (3, 4, 5))
_FUZZY = f"""WITH {TITLES}, r AS (SELECT CAST(page_id AS VARCHAR) AS record_id, {NORM.format("replace(title, '&amp;', '&')")} AS t FROM titles),
    fit AS (SELECT * FROM r WHERE length(t) >= 30 AND len(string_split(t, ' ')) >= 6), d AS (SELECT t, min(record_id) AS id, count(*) AS times FROM fit GROUP BY 1),
    words AS (SELECT id, times, concat(' ', unnest(string_split(t, ' ')), ' ') AS w FROM d), grams AS (SELECT id, times, g, count(*) AS tf FROM ({_GRAMS}) GROUP BY 1, 2, 3),
    known AS (SELECT g, sum(times) AS df FROM grams GROUP BY 1 HAVING sum(times) >= 2), x AS (SELECT id, g, tf * (ln((1e0 + (SELECT sum(times) FROM d)) / (1 + df)) + 1) AS x FROM grams JOIN known USING (g)),
    v AS (SELECT id, g, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM x), sim AS (SELECT a.id AS src, b.id AS dst, round(sum(a.x * b.x), 12) AS similarity FROM v a JOIN v b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2 HAVING round(sum(a.x * b.x), 12) >= 0.97),
    near AS (SELECT sim.*, s.times - 1 + coalesce(sum(e.times) OVER (PARTITION BY src ORDER BY similarity DESC, dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, length(s.t) AS l1, length(e.t) AS l2 FROM sim JOIN d s ON s.id = src JOIN d e ON e.id = dst)
    SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, round(similarity, 9) AS similarity FROM near WHERE before < 7 AND least(l1, l2) >= 0.85 * greatest(l1, l2)
    UNION ALL SELECT d.id, fit.record_id, 1.0 FROM fit JOIN d ON fit.t = d.t WHERE fit.record_id <> d.id"""


@query("family_fuzzy_edges", _FUZZY)
def family_fuzzy_edges(spark, sf):
    t = ampersand_titles(spark, sf).select(F.lit("pages").alias("dataset"), F.col("page_id").cast("string").alias("record_id"), "title")
    return L.fuzzy_title_edges(t).select("src", "dst", F.round("similarity", 9).alias("similarity"))


DOC_KEYS = f"{ITEMS}, h AS (SELECT record_id, dataset, substr(sha1({NORM.format('body_text')}), 1, 16) AS g FROM items)"


@query("family_components", f"WITH {DOC_KEYS}, f AS (SELECT record_id, dataset, min(record_id) OVER (PARTITION BY dataset, g) AS root FROM h) SELECT dataset, record_id, concat('family_', substr(sha1(concat(dataset, '||', root)), 1, 16)) AS family_group, count(*) OVER (PARTITION BY dataset, root) AS family_size FROM f")
def family_components(spark, sf):
    d = Workspace(spark).keep(items(spark, sf).select("dataset", "record_id", T.normalized_text_hash("body_text").alias("key")), "hashed")
    return L.families(d, L.key_edges(d))


@query("family_audit", f"WITH {DOC_KEYS}, f AS (SELECT dataset, g, count(*) AS n FROM h GROUP BY 1, 2) SELECT dataset, CAST(sum(n) AS BIGINT) AS records, count(*) AS families, count(*) FILTER (WHERE n > 1) AS multi_record, max(n) AS largest, CAST(sum(n) - count(*) AS BIGINT) AS unions FROM f GROUP BY 1")
def family_audit(spark, sf):
    return L.family_audit(family_components(spark, sf))


def _chain(rounds: int) -> str:
    """The least order of a component spreads to suppliers and back; each round reaches two links further."""
    steps = ["o0 AS (SELECT DISTINCT l_orderkey AS o, l_orderkey AS c FROM lineitem)"]
    for i in range(rounds):
        steps.append(f"s{i} AS (SELECT l_suppkey AS s, min(c) AS c FROM lineitem JOIN o{i} ON l_orderkey = o GROUP BY 1)")
        steps.append(f"o{i + 1} AS (SELECT l_orderkey AS o, min(c) AS c FROM lineitem JOIN s{i} ON l_suppkey = s GROUP BY 1)")
    return "WITH " + ", ".join(steps) + f" SELECT 2 * o AS node, 2 * c AS component FROM o{rounds} UNION ALL SELECT 2 * s + 1, 2 * c FROM s{rounds - 1}"


@query("components_chain", _chain(8))
def components_chain(spark, sf):
    from tessera.operators.graph import connected_components

    e = table(spark, sf, "lineitem").select((2 * F.col("l_orderkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"))
    got = connected_components(e)
    # a component is named by its least order, as the oracle does, rather than by its least node
    named = got.where("node % 2 = 0").groupBy("component").agg(F.min("node").alias("name"))
    return got.join(named, "component").select("node", F.col("name").alias("component"))


@query(
    "apply_quality_rules",
    f"""WITH {DOC_KEYS}, q AS (SELECT h.record_id, h.dataset, h.g, i.harmonized_label, min(i.harmonized_label) OVER (PARTITION BY h.dataset, h.g) AS lo, max(i.harmonized_label) OVER (PARTITION BY h.dataset, h.g) AS hi FROM h JOIN items i ON h.record_id = i.record_id),
    s AS (SELECT *, CASE WHEN coalesce(lo <> hi, false) THEN 'conflicting_exact_duplicate' ELSE '' END AS r FROM q), t AS (SELECT *, min(CASE WHEN r = '' THEN record_id END) OVER (PARTITION BY dataset, g) AS first FROM s)
    SELECT record_id, CASE WHEN r = '' AND record_id <> first THEN 'exact_duplicate' ELSE r END AS exclusion_reason FROM t""",
)
def apply_quality_rules(spark, sf):
    d = items(spark, sf).select("dataset", "record_id", "harmonized_label", T.normalized_text_hash("body_text").alias("duplicate_group"), F.lit("").alias("exclusion_reason"))
    d = Workspace(spark).keep(d, "hashed")  # the rules read it several times
    return L.apply_quality_rules(d).select("record_id", "exclusion_reason")


@query("assign_primary_cohorts", f"WITH {ITEMS}, w AS (SELECT record_id, dataset, text_unit, CAST(len(regexp_extract_all(body_text, '[\\p{{L}}\\p{{N}}_](?:[\\p{{L}}\\p{{N}}_''-]*[\\p{{L}}\\p{{N}}_])?')) AS BIGINT) AS n FROM items) SELECT record_id, concat(dataset, '_', text_unit) AS analysis_cohort, CASE WHEN text_unit <> 'article' THEN 'non_primary_text_unit' WHEN n < 30 THEN 'insufficient_body_text' ELSE '' END AS primary_exclusion_reason FROM w")
def assign_primary_cohorts(spark, sf):
    d = items(spark, sf).withColumn("model_text", F.col("body_text")).withColumn("exclusion_reason", F.lit(""))
    return L.assign_primary_cohorts(d, {x: ["article"] for x in ("en", "fr", "de", "es")}).select("record_id", "analysis_cohort", "primary_exclusion_reason")


def roster(spark, sf):
    return keyed(spark, sf).select("record_id", "dataset", F.when(F.col("y") == 1, "unreliable").otherwise("reliable").alias("harmonized_label"), F.when(F.col("record_id") % 3 == 0, "claim").otherwise("article").alias("text_unit"), "grp", F.col("o_orderdate").alias("ts"))


ROSTER = f"{KEYED}, roster AS (SELECT record_id, dataset, CASE WHEN y = 1 THEN 'unreliable' ELSE 'reliable' END AS harmonized_label, CASE WHEN record_id % 3 = 0 THEN 'claim' ELSE 'article' END AS text_unit, grp, o_orderdate AS ts FROM keyed)"


@query("split_standard")
def split_standard(spark, sf):
    return P.standard_split(roster(spark, sf), "grp")


@query("split_hash", f"WITH {ROSTER}, u AS (SELECT record_id, CAST(concat('0x', substr(sha1(concat('613|', CAST(grp AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0e0 AS u FROM roster) SELECT record_id, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'validation' ELSE 'test' END AS split FROM u")
def split_hash(spark, sf):
    return P.hash_split(roster(spark, sf), "grp").select("record_id", "split")


_BY = "CASE WHEN {u} < 0.6 THEN 'train' WHEN {u} < 0.8 THEN 'validation' ELSE 'test' END"
_DRAW = "CAST(concat('0x', substr(sha1(concat('613|', CAST({c} AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0e0"


@query(
    "split_valid",
    f"""WITH {ROSTER}, m AS (SELECT grp, dataset, {_BY.format(u=_DRAW.format(c="grp"))} AS by_group, {_BY.format(u=_DRAW.format(c="record_id"))} AS by_record FROM roster),
    g AS (SELECT count(DISTINCT by_group) AS a, count(DISTINCT by_record) AS b FROM m GROUP BY dataset, grp) SELECT 'group' AS design, count(*) FILTER (WHERE a > 1) > 0 AS crossing FROM g UNION ALL SELECT 'record', count(*) FILTER (WHERE b > 1) > 0 FROM g""",
)
def split_valid(spark, sf):
    found = [(kind, "a group crosses splits" in P.split_issues(P.hash_split(roster(spark, sf), c), "grp")) for kind, c in (("group", "grp"), ("record", "record_id"))]
    return spark.createDataFrame(found, "design string, crossing boolean")


@query(
    "split_score",
    f"""WITH {ROSTER}, m AS (SELECT *, CASE WHEN grp % 10 < 6 THEN 'train' WHEN grp % 10 < 8 THEN 'validation' ELSE 'test' END AS split, concat(text_unit, '__', harmonized_label) AS st FROM roster),
    s AS (SELECT unnest(['train', 'validation', 'test']) AS split, unnest([0.6, 0.2, 0.2]) AS target), o AS (SELECT st, 1.0e0 * count(*) / (SELECT count(*) FROM m) AS share FROM m GROUP BY 1), z AS (SELECT split, count(*) AS n FROM m GROUP BY 1), c AS (SELECT split, st, count(*) AS n FROM m GROUP BY 1, 2),
    gap AS (SELECT s.split, sum(abs(coalesce(1.0e0 * c.n / z.n, 0) - o.share)) AS g FROM s CROSS JOIN o JOIN z ON s.split = z.split LEFT JOIN c ON c.split = s.split AND c.st = o.st GROUP BY 1)
    SELECT round(sum(abs(1.0e0 * z.n / (SELECT count(*) FROM m) - s.target) + gap.g), 6) AS score FROM s JOIN z ON s.split = z.split JOIN gap ON gap.split = s.split""",
)
def split_score(spark, sf):
    r = F.col("grp") % 10
    m = roster(spark, sf).withColumn("split", F.when(r < 6, "train").when(r < 8, "validation").otherwise("test"))
    return P.split_score(m, P.SplitSettings()).select(F.round("score", 6).alias("score"))


_TRIED = f"""WITH {ROSTER}, per AS (SELECT grp, concat(text_unit, '__', harmonized_label) AS st, count(*) AS n FROM roster GROUP BY 1, 2),
    m AS (SELECT a, {_BY.format(u="u")} AS split, st, n FROM (SELECT a, st, n, CAST(concat('0x', substr(sha1(concat(CAST(613 + a AS VARCHAR), '|', CAST(grp AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0e0 AS u FROM per CROSS JOIN (SELECT unnest(generate_series(0, 499)) AS a))),
    s AS (SELECT unnest(['train', 'validation', 'test']) AS split, unnest([0.6, 0.2, 0.2]) AS target), o AS (SELECT st, 1.0e0 * sum(n) / (SELECT sum(n) FROM per) AS share FROM per GROUP BY 1), z AS (SELECT a, split, sum(n) AS n FROM m GROUP BY 1, 2), c AS (SELECT a, split, st, sum(n) AS n FROM m GROUP BY 1, 2, 3),
    gap AS (SELECT z.a, z.split, sum(abs(coalesce(1.0e0 * c.n / z.n, 0) - o.share)) AS g FROM z CROSS JOIN o LEFT JOIN c ON c.a = z.a AND c.split = z.split AND c.st = o.st GROUP BY 1, 2),
    scored AS (SELECT z.a, sum(abs(1.0e0 * z.n / (SELECT sum(n) FROM per) - s.target) + gap.g) AS score FROM s JOIN z ON s.split = z.split JOIN gap ON gap.a = z.a AND gap.split = s.split GROUP BY 1)"""


@query(
    "split_group_disjoint",
    f"""{_TRIED}, best AS (SELECT a FROM scored ORDER BY round(score, 9), a LIMIT 1)
    SELECT record_id, {_BY.format(u="u")} AS split FROM (SELECT record_id, CAST(concat('0x', substr(sha1(concat(CAST(613 + a AS VARCHAR), '|', CAST(grp AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0e0 AS u FROM roster CROSS JOIN best)""",
)
def split_group_disjoint(spark, sf):
    return P.group_disjoint_split(roster(spark, sf), "grp", 500).select("record_id", "split")


@query("split_repeats", f"{_TRIED} SELECT CAST(a AS INTEGER) AS attempt, round(score, 6) AS score FROM scored")
def split_repeats(spark, sf):
    return P.group_disjoint_attempts(roster(spark, sf), "grp", 100, repeats=5).select("attempt", F.round("score", 6).alias("score"))


@query(
    "split_temporal",
    f"""WITH {ROSTER}, f AS (SELECT grp, min(ts) AS first, max(ts) AS last FROM roster GROUP BY 1), s AS (SELECT grp, CASE WHEN last <= TIMESTAMP '1996-06-01' THEN 'train' WHEN first > TIMESTAMP '1996-06-01' AND last <= TIMESTAMP '1997-06-01' THEN 'validation' WHEN first > TIMESTAMP '1997-06-01' THEN 'test' END AS split FROM f)
    SELECT r.record_id, s.split FROM roster r JOIN s ON r.grp = s.grp WHERE s.split IS NOT NULL""",
)
def split_temporal(spark, sf):
    return P.temporal_split(roster(spark, sf), "ts", "grp", "1996-06-01", "1997-06-01").select("record_id", "split")


@query("split_temporal_cuts")
def split_temporal_cuts(spark, sf):
    return P.temporal_cut_scores(roster(spark, sf), "ts", "record_id")


@query("audit_sample")
def audit_sample(spark, sf):
    from tessera.operators.review import sample_roster

    k = keyed(spark, sf)
    out = F.when((F.col("y") == 1) & (F.col("pa") == 0), "false_negative").when((F.col("y") == 0) & (F.col("pa") == 1), "false_positive")
    c = k.select(out.alias("stratum"), "record_id", (F.col("record_id") % 3).cast("int").alias("sampling_priority"), F.col("dataset").alias("balance_group")).where("stratum IS NOT NULL")
    return sample_roster(c, [("false_negative", 20), ("false_positive", 20), ("deferred", 10)])[0]


@query("outcome_candidates", f"WITH {KEYED} SELECT record_id, CASE WHEN y = 1 THEN 'false_negative' ELSE 'false_positive' END AS stratum FROM keyed WHERE y <> pa UNION ALL SELECT record_id, 'model_disagreement' FROM keyed WHERE pa <> pb")
def outcome_candidates(spark, sf):
    k = keyed(spark, sf)
    a = k.where("y <> pa").select("record_id", F.when(F.col("y") == 1, "false_negative").otherwise("false_positive").alias("stratum"))
    return a.unionByName(k.where("pa <> pb").select("record_id", F.lit("model_disagreement").alias("stratum")))


@query("topic_review_sheet", f"WITH {ASSIGNMENTS} SELECT dataset, topic_id, count(DISTINCT record_id) AS records, '' AS human_label, '' AS human_decision FROM assignments WHERE topic_id <> -1 GROUP BY 1, 2 HAVING count(DISTINCT record_id) >= 20")
def topic_review_sheet(spark, sf):
    from tessera.operators.review import candidate_topics, topic_review_sheet

    return topic_review_sheet(candidate_topics(assignments(spark, sf), 20), ["human_label", "human_decision"]).drop("mean_probability", "eligible")


@query(
    "rep_review_sheet",
    f"""WITH {ASSIGNMENTS}, e AS (SELECT dataset, topic_id FROM assignments WHERE topic_id <> -1 GROUP BY 1, 2 HAVING count(DISTINCT record_id) >= 20), r AS (SELECT a.*, row_number() OVER (PARTITION BY a.dataset, a.topic_id ORDER BY assigned_probability DESC, record_id) AS rn FROM assignments a JOIN e ON a.dataset = e.dataset AND a.topic_id = e.topic_id)
    SELECT r.dataset, r.topic_id, r.record_id, r.rn AS representative_rank, substr(d.text, 1, 800) AS excerpt, '' AS human_stance FROM r LEFT JOIN documents d ON r.record_id = d.doc_id WHERE rn <= 5""",
)
def rep_review_sheet(spark, sf):
    from tessera.operators.review import candidate_topics, representative_sheet

    a = assignments(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), "text")
    got = representative_sheet(a, candidate_topics(a, 20), docs, 5, 800, ["human_stance"])
    return got.withColumn("representative_rank", F.col("representative_rank").cast("long"))


@query("two_stage_join", "SELECT c_custkey AS case_id, 'x' AS code_a, 'y' AS code_b FROM customer")
def two_stage_join(spark, sf):
    from tessera.operators.review import finalize_two_stage

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    status, _, got = finalize_two_stage(c.withColumn("code_a", F.lit("x")), c.withColumn("code_b", F.lit("y")))
    assert status == "completed"
    return got


@query("sheet_gates", "SELECT 'blank' AS gate, count(*) AS n FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'vocabulary', count(*) FROM nation WHERE n_nationkey % 5 = 1")
def sheet_gates(spark, sf):
    from tessera.operators.review import finalize_sheet

    t = table(spark, sf, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey") % 5
    s = t.withColumn("stance", F.when(k == 0, "").when(k == 1, "odd").otherwise(" Support "))
    status, issues, coded = finalize_sheet(s, t, ["n_nationkey"], ["n_name"], {"stance": ("support", "oppose")})
    assert status == "awaiting_human_validation" and coded is None
    return issues.groupBy("gate").agg(F.count("*").alias("n"))


@query(
    "finalize_audit",
    """WITH c AS (SELECT c_custkey AS k FROM customer), v AS (
        SELECT 'stage_a_health_relevant_signal' AS field, CASE k % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unclear' END AS value FROM c
        UNION ALL SELECT 'stage_a_source_or_dataset_artifact', 'no' FROM c UNION ALL SELECT 'stage_a_label_ambiguity', CASE WHEN k % 7 = 0 THEN 'unclear' ELSE 'yes' END FROM c
        UNION ALL SELECT 'stage_a_stance', CASE WHEN k % 2 = 0 THEN 'mixed' ELSE 'not_applicable' END FROM c UNION ALL SELECT 'stage_b_error_code', CASE WHEN k % 5 = 0 THEN 'topic_shortcut' ELSE 'no_model_error' END FROM c)
        SELECT field, value, count(*) AS n, round(1.0e0 * count(*) / (SELECT count(*) FROM c), 6) AS fraction FROM v GROUP BY 1, 2""",
)
def finalize_audit(spark, sf):
    from tessera.operators import finishing as Z

    k = F.col("c_custkey")
    context = [F.concat(F.lit("case_"), k).alias("case_id"), F.lit(Z.AUDIT_VERSION).alias("audit_protocol_version"), F.lit("r").alias("audit_roster_sha256")]
    revealed = [k.cast("string").alias(c) for c in Z.AUDIT_REVEALED]
    three = F.element_at(F.array(F.lit("Yes"), F.lit(" no"), F.lit("unclear")), (k % 3 + 1).cast("int"))
    coded = [three, F.lit("no"), F.when(k % 7 == 0, "unclear").otherwise("YES"), F.when(k % 2 == 0, "mixed").otherwise("not_applicable"), F.lit("seen")]
    error = [F.when(k % 5 == 0, "topic_shortcut").otherwise("no_model_error"), F.lit("read")]
    a_fields, b_fields = (*Z.AUDIT_SIGNALS, "stage_a_stance", "stage_a_notes"), ("stage_b_error_code", "stage_b_review_notes")
    c = table(spark, sf, "customer")
    a = c.select(*context, *[x.alias(f) for x, f in zip(coded, a_fields, strict=True)])
    b = c.select(*context, *revealed, *[x.alias(f) for x, f in zip(error, b_fields, strict=True)])
    template = c.select(*context, *revealed, *[F.lit("").alias(f) for f in (*a_fields, *b_fields)])
    status, issues, _, summary = Z.finalize_audit(a, b, template)
    assert status == "completed", issues.take(5)
    return summary


_REVIEWED = f"""WITH {ASSIGNMENTS}, c AS (SELECT dataset, topic_id, count(DISTINCT record_id) AS records FROM assignments WHERE topic_id <> -1 GROUP BY 1, 2 HAVING count(DISTINCT record_id) >= 5),
    r AS (SELECT *, row_number() OVER (PARTITION BY dataset, topic_id ORDER BY assigned_probability DESC, record_id) AS rn FROM assignments),
    s AS (SELECT dataset, topic_id, count(*) AS seen, count(*) FILTER (WHERE record_id % 3 <> 0) AS support FROM r WHERE rn <= 5 GROUP BY 1, 2),
    t AS (SELECT c.*, seen, support, topic_id % 4 = 3 AS unsound FROM c JOIN s USING (dataset, topic_id)),
    n AS (SELECT dataset, concat('n', topic_id % 3) AS final_narrative_id, sum(records) AS records, string_agg(CAST(topic_id AS VARCHAR), '|' ORDER BY topic_id) AS topics, sum(seen) AS seen, sum(support) AS support FROM t WHERE NOT unsound GROUP BY 1, 2)"""


def _reviewed(spark, sf):
    """Sheets as a reviewer might fill them: topics 3 and 7 are mixed, three narratives a dataset."""
    from tessera.operators import finishing as Z
    from tessera.operators.review import candidate_topics, representative_sheet

    a = assignments(spark, sf)
    c = candidate_topics(a, 5)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), "text")
    expected = representative_sheet(a, c, docs, 5, 800)
    shown = expected.withColumns({"human_supports_topic": F.when(F.col("record_id") % 3 != 0, "Yes").otherwise("no"), "human_stance": F.lit("discussion"), "human_artifact_pattern": F.lit("none"), "human_review_confirmation": F.lit("human_reviewed")})
    c = c.withColumnRenamed("eligible", "eligible_topic_size").withColumn("machine_topic_name", F.concat(F.lit("topic "), "topic_id"))
    k = F.col("topic_id")
    entered = {
        "human_topic_coherence": F.when(k % 4 == 3, "mixed").otherwise(" Coherent"),
        "human_topic_stance": F.lit("mixed"),
        "human_artifact_pattern": F.lit("none"),
        "human_review_confirmation": F.lit("human_reviewed"),
        "human_narrative_id": F.concat(F.lit("n"), k % 3),
        "human_narrative_label": F.concat(F.lit("Story "), k % 3),
        "human_label_source": F.lit("reviewer_authored"),
    }
    topics = c.where("eligible_topic_size").withColumns(entered)
    got = Z.finalize_narratives(c, topics, shown, expected, least_documents=20, least_representatives=5)
    assert got[0] == "completed", got[1].take(5)
    return got


_KEPT = "records >= 20 AND support >= 5"


@query(
    "finalize_narratives",
    f"""{_REVIEWED} SELECT dataset, final_narrative_id, concat('Story ', substr(final_narrative_id, 2)) AS candidate_narrative_label, CAST(records AS BIGINT) AS records, topics, CAST(seen AS BIGINT) AS representatives_reviewed,
        CAST(support AS BIGINT) AS representatives_supporting, {_KEPT} AS retained, CASE WHEN records < 20 THEN 'fewer_than_minimum_documents' WHEN support < 5 THEN 'fewer_than_minimum_supporting_representatives' ELSE 'retained_after_human_validation' END AS retention_reason FROM n""",
)
def finalize_narratives(spark, sf):
    return _reviewed(spark, sf)[2]


@query(
    "narrative_outcomes",
    f"""{_REVIEWED} SELECT t.dataset, CAST(topic_id AS BIGINT) AS topic_id, NOT unsound AND coalesce({_KEPT.replace("records", "n.records").replace("support", "n.support")}, false) AS retained,
        CASE WHEN unsound THEN 'rejected_mixed' WHEN {_KEPT.replace("records", "n.records").replace("support", "n.support")} THEN 'retained_after_human_validation' ELSE 'rejected_by_narrative_retention_gate' END AS retention_reason
        FROM t LEFT JOIN n ON n.dataset = t.dataset AND n.final_narrative_id = concat('n', topic_id % 3)""",
)
def narrative_outcomes(spark, sf):
    return _reviewed(spark, sf)[4].select("dataset", "topic_id", "retained", "retention_reason")


@query("agg_narrative_perf", f"WITH {KEYED}, g AS (SELECT dataset, record_id % 7 AS narrative_id, count(*) AS n, count(*) FILTER (WHERE y = 1 AND pa = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pa = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pa = 0) AS fn, count(*) FILTER (WHERE y = 0 AND pa = 0) AS tn FROM keyed GROUP BY 1, 2) SELECT dataset, narrative_id, n, n >= 20 AND tp + fn >= 5 AND tn + fp >= 5 AS eligible, CASE WHEN n >= 20 AND tp + fn >= 5 AND tn + fp >= 5 THEN round((2.0e0 * tp / (2 * tp + fp + fn) + 2.0e0 * tn / (2 * tn + fp + fn)) / 2, 6) END AS macro_f1, CASE WHEN n >= 20 AND tp + fn >= 5 AND tn + fp >= 5 THEN round(2.0e0 * tp / (2 * tp + fp + fn), 6) END AS unreliable_f1 FROM g")
def agg_narrative_perf(spark, sf):
    from tessera.operators.review import narrative_performance

    k = keyed(spark, sf).withColumn("p", F.col("pa")).withColumn("narrative_id", F.col("record_id") % 7)
    return narrative_performance(k, ["dataset", "narrative_id"])


@query("assigned_probability", "SELECT vec_id, round(CASE WHEN label = 9 THEN 1 - list_max(e) ELSE e[label + 1] END, 5) AS p FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)")
def assigned_probability(spark, sf):
    from tessera.operators.review import assigned_probability

    e = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("t"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", F.round(assigned_probability(F.col("t"), F.col("e")), 5).alias("p"))


@query("conditional_gates", "SELECT * FROM (VALUES ('ablation', 'available', ''), ('transfer', 'unavailable', 'one dataset'), ('narratives', 'available', '')) AS t(analysis, status, reason)")
def conditional_gates(spark, sf):
    from tessera.operators.review import conditional_gates

    return conditional_gates(spark, [("ablation", True, ""), ("transfer", False, "one dataset"), ("narratives", True, "")])
