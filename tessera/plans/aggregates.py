"""Aggregations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.adapters import ASSIGNMENTS, ENGAGEMENT, ITEMS, KEYED, PREDS, assignments, engagement, items, keyed, predictions, table
from tessera.plans.registry import query

NORM = "substr(sha1(trim(regexp_replace(lower(body_text), '[^a-z0-9]+', ' ', 'g'))), 1, 16)"


@query(
    "exclusion_flow",
    f"""WITH {ITEMS}, h AS (SELECT *, {NORM} AS g FROM items), r AS (SELECT dataset, CASE WHEN length(trim(body_text)) < 100 THEN 'short_text'
    WHEN row_number() OVER (PARTITION BY dataset, g ORDER BY record_id) > 1 THEN 'exact_duplicate' ELSE 'included' END AS status FROM h)
    SELECT dataset, status, count(*) AS n FROM r GROUP BY 1, 2""",
)
def exclusion_flow(spark, sf):
    """Flagship: normalise, find duplicates, give reasons, and count the flow."""
    d = items(spark, sf).select("dataset", "record_id", F.length(F.trim("body_text")).alias("n"), T.normalized_text_hash("body_text").alias("g"))
    first = F.min("record_id").over(W.partitionBy("dataset", "g"))
    reason = F.when(F.col("n") < 100, "short_text").when(F.col("record_id") != first, "exact_duplicate").otherwise("")
    flow = d.withColumn("reason", reason)
    return flow.groupBy("dataset", F.when(F.col("reason") == "", "included").otherwise(F.col("reason")).alias("status")).agg(F.count("*").alias("n"))


@query("case_outcome", f"WITH {PREDS} SELECT CASE WHEN y = 1 AND p = 1 THEN 'true_positive' WHEN y = 0 AND p = 0 THEN 'true_negative' WHEN y = 0 AND p = 1 THEN 'false_positive' ELSE 'false_negative' END AS outcome, count(*) AS n FROM preds GROUP BY 1")
def case_outcome(spark, sf):
    y, p = F.col("y") == 1, F.col("p") == 1
    out = F.when(y & p, "true_positive").when(~y & ~p, "true_negative").when(~y & p, "false_positive").otherwise("false_negative")
    return predictions(spark, sf).groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


@query("cascade_reason", "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE '' END AS reason FROM orders")
def cascade_reason(spark, sf):
    r = F.coalesce(F.when(F.col("o_totalprice") < 1000, "small"), F.when(F.col("o_orderstatus") == "P", "pending"), F.when(F.col("o_orderpriority") == "5-LOW", "low"), F.lit(""))
    return table(spark, sf, "orders").select("o_orderkey", r.alias("reason"))


@query("label_dictionary", "SELECT * FROM (VALUES ('coaid','fake','unreliable'),('coaid','real','reliable'),('fakehealth','rating_0','unreliable'),('fakehealth','rating_1','unreliable'),('fakehealth','rating_2','unreliable'),('fakehealth','rating_3','reliable'),('fakehealth','rating_4','reliable'),('fakehealth','rating_5','reliable')) AS t(dataset, native_label, harmonized_label)")
def label_dictionary(spark, sf):
    from tessera.sources.items import label_dictionary

    return label_dictionary(spark)


@query("agg_count_distinct", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1")
def agg_count_distinct(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("n"))


@query("agg_stratum_pivot", f"WITH {ITEMS} SELECT source_name, count(*) FILTER (WHERE text_unit = 'article' AND harmonized_label = 'reliable') AS article__reliable, count(*) FILTER (WHERE text_unit = 'article' AND harmonized_label = 'unreliable') AS article__unreliable, count(*) FILTER (WHERE text_unit = 'claim' AND harmonized_label = 'reliable') AS claim__reliable, count(*) FILTER (WHERE text_unit = 'claim' AND harmonized_label = 'unreliable') AS claim__unreliable, count(*) AS records FROM items GROUP BY 1")
def agg_stratum_pivot(spark, sf):
    from tessera.operators.splits import stratum_pivot

    return stratum_pivot(items(spark, sf), "source_name", [f"{u}__{x}" for u in ("article", "claim") for x in ("reliable", "unreliable")])


@query("agg_family_dates", "SELECT o_custkey AS family, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) AS n FROM orders GROUP BY 1")
def agg_family_dates(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("family")).agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count("*").alias("n"))


@query("agg_split_dist", f"WITH {KEYED} SELECT dataset, CASE WHEN grp % 10 < 6 THEN 'train' WHEN grp % 10 < 8 THEN 'validation' ELSE 'test' END AS split, y, count(*) AS n FROM keyed GROUP BY 1, 2, 3")
def agg_split_dist(spark, sf):
    r = F.col("grp") % 10
    return keyed(spark, sf).groupBy("dataset", F.when(r < 6, "train").when(r < 8, "validation").otherwise("test").alias("split"), "y").agg(F.count("*").alias("n"))


def manifest(spark, sf):
    r = F.col("grp") % 10
    return keyed(spark, sf).withColumn("split", F.when(r < 6, "train").when(r < 8, "validation").otherwise("test")).withColumn("harmonized_label", F.when(F.col("y") == 1, "unreliable").otherwise("reliable"))


MANIFEST = f"{KEYED}, manifest AS (SELECT *, CASE WHEN grp % 10 < 6 THEN 'train' WHEN grp % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM keyed)"


@query(
    "agg_split_quality",
    f"""WITH {MANIFEST}, g AS (SELECT dataset, split, grp, count(*) AS n, sum(y) AS pos FROM manifest GROUP BY 1, 2, 3),
    s AS (SELECT dataset, split, CAST(sum(n) AS BIGINT) AS records, sum(pos) AS pos, count(*) AS groups, CAST(sum(n) AS DOUBLE) * sum(n) / sum(n * n) AS e, max(n) AS m FROM g GROUP BY 1, 2)
    SELECT dataset, split, records, round(records * 1.0 / sum(records) OVER (PARTITION BY dataset), 6) AS fraction, round(pos * 1.0 / records, 6) AS positive_share, groups, round(e, 6) AS effective_groups, round(m * 1.0 / records, 6) AS largest_group_share FROM s""",
)
def agg_split_quality(spark, sf):
    from tessera.operators.splits import split_quality

    return split_quality(manifest(spark, sf), "grp")


@query("agg_split_integrity", f"WITH {MANIFEST}, k AS (SELECT dataset, grp, count(DISTINCT split) AS k FROM manifest GROUP BY 1, 2) SELECT dataset, max(k) AS most_splits, count(*) FILTER (WHERE k > 1) AS crossing, 'grp' AS group_column FROM k GROUP BY 1")
def agg_split_integrity(spark, sf):
    from tessera.operators.splits import split_integrity

    return split_integrity(manifest(spark, sf), ["grp"])


@query("agg_leakage_audit", "SELECT lang AS dataset, count(*) FILTER (WHERE trim(text) <> '') AS non_empty, CAST(sum(len(regexp_extract_all(text, '(?i)\\blicense\\b'))) AS BIGINT) AS hits, CAST(sum(CASE WHEN regexp_matches(text, 'https?://') THEN 1 ELSE 0 END) AS BIGINT) AS with_url FROM documents GROUP BY 1")
def agg_leakage_audit(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("dataset")).agg(F.count_if(F.trim("text") != "").alias("non_empty"), F.sum(T.count_terms(F.col("text"), (r"\blicense\b",)).cast("long")).alias("hits"), F.count_if(F.col("text").rlike("https?://")).alias("with_url"))


@query("agg_dup_conflicts", f"WITH {ITEMS}, h AS (SELECT dataset, {NORM} AS duplicate_group, harmonized_label FROM items WHERE harmonized_label IS NOT NULL) SELECT dataset, duplicate_group, count(DISTINCT harmonized_label) > 1 AS conflict FROM h GROUP BY 1, 2")
def agg_dup_conflicts(spark, sf):
    d = items(spark, sf).where("harmonized_label IS NOT NULL").select("dataset", T.normalized_text_hash("body_text").alias("duplicate_group"), "harmonized_label")
    return d.groupBy("dataset", "duplicate_group").agg((F.min("harmonized_label") != F.max("harmonized_label")).alias("conflict"))


@query("agg_dup_report", f"WITH {ITEMS}, h AS (SELECT dataset, {NORM} AS g, source_name FROM items) SELECT dataset, 'duplicate' AS kind, g AS key, count(*) AS n FROM h GROUP BY 1, 3 HAVING count(*) > 1 UNION ALL SELECT dataset, 'source', source_name, count(*) FROM h GROUP BY 1, 3 HAVING count(*) > 1")
def agg_dup_report(spark, sf):
    d = items(spark, sf).select("dataset", T.normalized_text_hash("body_text").alias("g"), "source_name")
    part = lambda kind, c: d.groupBy("dataset", F.lit(kind).alias("kind"), F.col(c).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    return part("duplicate", "g").unionByName(part("source", "source_name"))


@query("agg_family_stats", "WITH f AS (SELECT o_orderstatus AS dataset, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) SELECT dataset, count(*) AS families, count(*) FILTER (WHERE n > 1) AS multi, max(n) AS largest FROM f GROUP BY 1")
def agg_family_stats(spark, sf):
    f = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("dataset"), "o_custkey").agg(F.count("*").alias("n"))
    return f.groupBy("dataset").agg(F.count("*").alias("families"), F.count_if(F.col("n") > 1).alias("multi"), F.max("n").alias("largest"))


@query("agg_flow", "SELECT lang AS dataset, CASE WHEN n_chars < 300 THEN 'short' ELSE 'included' END AS status, count(*) AS n FROM documents GROUP BY 1, 2")
def agg_flow(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("dataset"), F.when(F.col("n_chars") < 300, "short").otherwise("included").alias("status")).agg(F.count("*").alias("n"))


@query("agg_unit_label", f"WITH {ITEMS} SELECT dataset, text_unit, harmonized_label, count(*) AS n FROM items GROUP BY 1, 2, 3")
def agg_unit_label(spark, sf):
    return items(spark, sf).groupBy("dataset", "text_unit", "harmonized_label").agg(F.count("*").alias("n"))


@query("agg_native_label", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def agg_native_label(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("agg_publisher_audit", "SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2, 3 ORDER BY 1, n DESC")
def agg_publisher_audit(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n")).orderBy("p_brand", F.desc("n"))


@query("agg_date_audit", "SELECT event_type AS dataset, count(*) AS n, count(ts) AS with_date, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS days FROM events GROUP BY 1")
def agg_date_audit(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("n"), F.count("ts").alias("with_date"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("agg_content_quality", f"WITH {ITEMS} SELECT dataset, text_unit, count(*) AS n, count(*) FILTER (WHERE n_chars > 500) AS long_texts, round(median(n_chars), 6) AS median_chars FROM items GROUP BY 1, 2")
def agg_content_quality(spark, sf):
    return items(spark, sf).groupBy("dataset", "text_unit").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 500).alias("long_texts"), F.round(F.percentile("n_chars", 0.5), 6).alias("median_chars"))


@query("agg_language_audit", "WITH f AS (SELECT lang, text, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS a, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS b FROM documents) SELECT lang AS dataset, count(*) AS n, count(*) FILTER (WHERE a >= 50 AND b < 0.95 * a) AS flagged, round(min(CASE WHEN a > 0 THEN b * 1.0 / a END), 6) AS least FROM f GROUP BY 1")
def agg_language_audit(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.length(F.regexp_replace("text", r"[^\p{L}]", "")).alias("a"), F.length(F.regexp_replace("text", "[^A-Za-z]", "")).alias("b"))
    return d.groupBy(F.col("lang").alias("dataset")).agg(F.count("*").alias("n"), F.count_if((F.col("a") >= 50) & (F.col("b") < 0.95 * F.col("a"))).alias("flagged"), F.round(F.min(F.when(F.col("a") > 0, F.col("b") / F.col("a"))), 6).alias("least"))


@query("agg_missingness", f"WITH {ITEMS} SELECT dataset, 'harmonized_label' AS column_name, round(avg(CASE WHEN coalesce(harmonized_label, '') = '' THEN 1.0 ELSE 0.0 END), 6) AS blank FROM items GROUP BY 1 UNION ALL SELECT dataset, 'source_name', round(avg(CASE WHEN coalesce(source_name, '') = '' THEN 1.0 ELSE 0.0 END), 6) FROM items GROUP BY 1")
def agg_missingness(spark, sf):
    from tessera.operators.profile import missingness

    return missingness(items(spark, sf), ["dataset"], ["harmonized_label", "source_name"])


@query("agg_data_dictionary", "SELECT 'lang' AS column_name, 'string' AS dtype, count(lang) AS present FROM documents UNION ALL SELECT 'doc_id', 'bigint', count(doc_id) FROM documents UNION ALL SELECT 'n_chars', 'bigint', count(n_chars) FROM documents")
def agg_data_dictionary(spark, sf):
    from tessera.operators.profile import data_dictionary

    return data_dictionary(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"))


@query("agg_engagement_gate", f"WITH {ENGAGEMENT}, s AS (SELECT avg(CASE WHEN engagement_available THEN 1.0 ELSE 0.0 END) AS coverage, count(*) FILTER (WHERE engagement_available AND user_id % 2 = 0) AS n0, count(*) FILTER (WHERE engagement_available AND user_id % 2 = 1) AS n1, count(DISTINCT tweet_count) AS totals FROM engagement) SELECT round(coverage, 6) AS coverage, n0, n1, totals, coverage >= 0.6 AND n0 >= 100 AND n1 >= 100 AND totals > 1 AS passed FROM s")
def agg_engagement_gate(spark, sf):
    e, a = engagement(spark, sf), F.col("engagement_available")
    s = e.agg(F.avg(a.cast("double")).alias("coverage"), F.count_if(a & (F.col("user_id") % 2 == 0)).alias("n0"), F.count_if(a & (F.col("user_id") % 2 == 1)).alias("n1"), F.countDistinct("tweet_count").alias("totals"))
    ok = (F.col("coverage") >= 0.6) & (F.col("n0") >= 100) & (F.col("n1") >= 100) & (F.col("totals") > 1)
    return s.select(F.round("coverage", 6).alias("coverage"), "n0", "n1", "totals", ok.alias("passed"))


@query("agg_contexts", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def agg_contexts(spark, sf):
    j = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(j("o_orderstatus").alias("statuses"), j("o_orderpriority").alias("priorities"))


@query("agg_repeat_summary", "SELECT l_returnflag AS dataset, l_linestatus AS model, count(DISTINCT l_suppkey) AS repeats, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS sd, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY 1, 2")
def agg_repeat_summary(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("model")).agg(F.countDistinct("l_suppkey").alias("repeats"), F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.stddev_samp("l_discount"), 6).alias("sd"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"))


@query("agg_lr_summary", "SELECT l_tax AS rate, count(DISTINCT l_suppkey) AS seeds, round(avg(l_discount), 6) AS mean, min(l_discount) AS low FROM lineitem GROUP BY 1")
def agg_lr_summary(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_tax").alias("rate")).agg(F.countDistinct("l_suppkey").alias("seeds"), F.round(F.avg("l_discount"), 6).alias("mean"), F.min("l_discount").alias("low"))


@query("agg_candidate_topics", f"WITH {ASSIGNMENTS} SELECT dataset, topic_id, count(DISTINCT record_id) AS records, round(avg(assigned_probability), 5) AS mean_probability, count(DISTINCT record_id) >= 30 AS eligible FROM assignments WHERE topic_id <> -1 GROUP BY 1, 2")
def agg_candidate_topics(spark, sf):
    from tessera.operators.review import candidate_topics

    return candidate_topics(assignments(spark, sf), 30)


@query("agg_prevalence", f"WITH {ASSIGNMENTS}, n AS (SELECT dataset, count(DISTINCT record_id) AS total FROM assignments GROUP BY 1), g AS (SELECT dataset, topic_id % 3 AS narrative_id, count(DISTINCT record_id) AS records FROM assignments WHERE topic_id >= 0 GROUP BY 1, 2) SELECT g.dataset, g.narrative_id, g.records, round(g.records * 1.0 / n.total, 6) AS prevalence FROM g JOIN n ON g.dataset = n.dataset")
def agg_prevalence(spark, sf):
    from tessera.operators.review import prevalence

    a = assignments(spark, sf)
    return prevalence(a.where("topic_id >= 0").withColumn("narrative_id", F.col("topic_id") % 3), a)


@query("agg_meta_profile", f"WITH {KEYED}, v AS (SELECT dataset, 'score_a' AS field, score_a AS x FROM keyed UNION ALL SELECT dataset, 'score_b', score_b FROM keyed) SELECT dataset, field, count(x) AS n, CASE WHEN count(x) >= 30 THEN round(avg(x), 6) END AS mean, CASE WHEN count(x) >= 30 THEN round(median(x), 6) END AS median, CASE WHEN count(x) >= 30 THEN round(stddev_samp(x), 6) END AS sd FROM v GROUP BY 1, 2")
def agg_meta_profile(spark, sf):
    from tessera.operators.review import metadata_profile

    return metadata_profile(keyed(spark, sf), ["dataset"], ["score_a", "score_b"], 30)


@query("agg_narrative_merge", f"WITH {ASSIGNMENTS} SELECT dataset, topic_id % 3 AS narrative_id, count(*) AS records, string_agg(DISTINCT CAST(topic_id AS VARCHAR), '|' ORDER BY CAST(topic_id AS VARCHAR)) AS topics FROM assignments WHERE topic_id >= 0 GROUP BY 1, 2")
def agg_narrative_merge(spark, sf):
    return assignments(spark, sf).where("topic_id >= 0").groupBy("dataset", (F.col("topic_id") % 3).alias("narrative_id")).agg(F.count("*").alias("records"), F.array_join(F.array_sort(F.collect_set(F.col("topic_id").cast("string"))), "|").alias("topics"))


@query("agg_code_summary", "WITH u AS (SELECT 'o_orderstatus' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) SELECT field, value, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY field), 6) AS fraction FROM u GROUP BY 1, 2")
def agg_code_summary(spark, sf):
    from tessera.operators.review import code_summary

    return code_summary(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("agg_stability_summary", f"WITH {KEYED} SELECT dataset, count(DISTINCT grp) AS groups, round(avg(score_a) FILTER (WHERE y = 1), 6) AS mean_held, round(median(score_a) FILTER (WHERE y = 1), 6) AS median_held FROM keyed GROUP BY 1")
def agg_stability_summary(spark, sf):
    held = F.when(F.col("y") == 1, F.col("score_a"))
    return keyed(spark, sf).groupBy("dataset").agg(F.countDistinct("grp").alias("groups"), F.round(F.avg(held), 6).alias("mean_held"), F.round(F.percentile(held, 0.5), 6).alias("median_held"))


@query("agg_discovery_gate", f"WITH {ITEMS} SELECT dataset, count(*) FILTER (WHERE harmonized_label = 'unreliable') AS unreliable, count(*) FILTER (WHERE harmonized_label = 'unreliable') >= 20 AS passed FROM items GROUP BY 1")
def agg_discovery_gate(spark, sf):
    n = F.count_if(F.col("harmonized_label") == "unreliable")
    return items(spark, sf).groupBy("dataset").agg(n.alias("unreliable"), (n >= 20).alias("passed"))


@query("agg_cohort_profile", f"WITH {ITEMS} SELECT dataset, count(*) AS records, count(DISTINCT coalesce(harmonized_label, '(missing)')) AS labels, count(DISTINCT source_name) AS sources FROM items GROUP BY 1")
def agg_cohort_profile(spark, sf):
    from tessera.operators.shift import coded

    return items(spark, sf).groupBy("dataset").agg(F.count("*").alias("records"), F.countDistinct(coded(F.col("harmonized_label"))).alias("labels"), F.countDistinct(coded(F.col("source_name"))).alias("sources"))


@query("agg_token_audit", "WITH t AS (SELECT lang, len(string_split_regex(trim(text), '\\s+')) AS n FROM documents WHERE trim(text) <> '') SELECT lang, count(*) AS docs, round(avg(CASE WHEN n > 512 THEN 1.0 ELSE 0.0 END), 6) AS over_512, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95 FROM t GROUP BY 1")
def agg_token_audit(spark, sf):
    d = table(spark, sf, "documents").where("trim(text) <> ''").select("lang", F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("n"))
    q = F.percentile("n", F.array(F.lit(0.5), F.lit(0.95)))
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.avg((F.col("n") > 512).cast("double")), 6).alias("over_512"), F.round(q[0], 6).alias("median"), F.round(q[1], 6).alias("p95"))
