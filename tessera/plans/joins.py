"""Joins, set operations, windows and top-k over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.adapters import ASSIGNMENTS, ITEMS, KEYED, TITLES, assignments, items, keyed, table, titles
from tessera.plans.registry import query


@query("join_manifest", f"WITH {KEYED} SELECT k.record_id, k.y, c.c_mktsegment FROM keyed k JOIN (SELECT c_custkey, c_mktsegment FROM customer) c ON k.grp = c.c_custkey")
def join_manifest(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("grp"), "c_mktsegment")
    return R.join_checked(keyed(spark, sf), c, ["grp"], validate="m:1").select("record_id", "y", "c_mktsegment")


@query("join_manifest_composite", f"WITH {KEYED} SELECT k.record_id, k.grp, o.o_totalprice AS total FROM keyed k JOIN orders o ON k.record_id = o.o_orderkey AND k.grp = o.o_custkey WHERE k.y = 1")
def join_manifest_composite(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("grp"), F.col("o_totalprice").alias("total"))
    return keyed(spark, sf).where("y = 1").select("record_id", "grp").join(o, ["record_id", "grp"])


@query("join_model_pair", f"WITH {KEYED} SELECT a.record_id, a.pa AS p_a, b.pb AS p_b FROM keyed a JOIN keyed b ON a.record_id = b.record_id")
def join_model_pair(spark, sf):
    k = keyed(spark, sf)
    return R.join_checked(k.select("record_id", F.col("pa").alias("p")), k.select("record_id", F.col("pb").alias("p")), ["record_id"], validate="1:1", suffixes=("_a", "_b"))


@query("join_model_pair_strict", f"WITH {KEYED} SELECT record_id, y AS y_a, pa AS p_a, y AS y_b, pb AS p_b FROM keyed")
def join_model_pair_strict(spark, sf):
    from tessera.operators.study import paired_predictions

    k = keyed(spark, sf)
    return paired_predictions(k.select("record_id", "y", F.col("pa").alias("p")), k.select("record_id", "y", F.col("pb").alias("p")))


@query("join_common_subset", f"WITH {KEYED} SELECT a.record_id, a.pa AS p_primary, b.pb AS p_retrained FROM keyed a JOIN keyed b ON a.record_id = b.record_id WHERE a.record_id % 2 = 0 AND b.record_id % 3 = 0")
def join_common_subset(spark, sf):
    k = keyed(spark, sf)
    a, b = k.where("record_id % 2 = 0").select("record_id", F.col("pa").alias("p")), k.where("record_id % 3 = 0").select("record_id", F.col("pb").alias("p"))
    return R.join_checked(a, b, ["record_id"], validate="1:1", suffixes=("_primary", "_retrained"))


@query("join_restore_group", f"WITH {KEYED} SELECT record_id, grp FROM keyed")
def join_restore_group(spark, sf):
    k = keyed(spark, sf)
    groups = R.distinct_first(k.select("record_id", "grp"), ["record_id"], ["grp"])
    got = k.select("record_id").join(groups, "record_id", "left")
    return got.withColumn("grp", F.coalesce("grp", F.raise_error(F.lit("a record has no group")).cast("long")))


@query("join_narrative_baseline", f"WITH {KEYED}, {ASSIGNMENTS} SELECT k.record_id, k.y, a.topic_id FROM keyed k JOIN assignments a ON k.record_id = a.record_id")
def join_narrative_baseline(spark, sf):
    return keyed(spark, sf).select("record_id", "y").join(assignments(spark, sf).select("record_id", "topic_id"), "record_id")


@query("join_context", "SELECT c.c_custkey, coalesce(o.n, 0) AS n, coalesce(o.statuses, '') AS statuses FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey")
def join_context(spark, sf):
    ctx = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "|").alias("statuses"))
    return R.join_checked(table(spark, sf, "customer").select("c_custkey"), ctx, ["c_custkey"], "left", "m:1").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("statuses", F.lit("")).alias("statuses"))


@query("join_explain_cases", "SELECT o.o_orderkey, c.c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_explain_cases(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").drop("o_custkey")


@query("join_verify_refit", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_verify_refit(spark, sf):
    return R.join_checked(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "toxic"), ["doc_id"], "left", "1:1")


@query("join_explain_pair", f"WITH {KEYED} SELECT dataset, record_id, score_a AS score_standard, score_b AS score_controlled FROM keyed")
def join_explain_pair(spark, sf):
    k = keyed(spark, sf)
    return R.join_checked(k.select("dataset", "record_id", F.col("score_a").alias("score")), k.select("dataset", "record_id", F.col("score_b").alias("score")), ["dataset", "record_id"], validate="1:1", suffixes=("_standard", "_controlled"))


@query("join_topic_descr", f"WITH {ASSIGNMENTS}, t AS (SELECT dataset, topic_id, count(*) AS records FROM assignments WHERE topic_id <> -1 GROUP BY 1, 2) SELECT t.dataset, t.topic_id, t.records, n.n_name AS name FROM t LEFT JOIN nation n ON t.topic_id = n.n_nationkey")
def join_topic_descr(spark, sf):
    t = assignments(spark, sf).where("topic_id <> -1").groupBy("dataset", "topic_id").agg(F.count("*").alias("records"))
    return t.join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("name")), "topic_id", "left")


@query("join_rep_eligible", f"WITH {ASSIGNMENTS} SELECT record_id, dataset, topic_id FROM assignments WHERE (dataset, topic_id) IN (SELECT dataset, topic_id FROM assignments WHERE topic_id <> -1 GROUP BY 1, 2 HAVING count(*) >= 20)")
def join_rep_eligible(spark, sf):
    a = assignments(spark, sf)
    ok = a.where("topic_id <> -1").groupBy("dataset", "topic_id").count().where("count >= 20")
    return a.join(ok, ["dataset", "topic_id"], "left_semi").select("record_id", "dataset", "topic_id")


@query("join_rep_docs", f"WITH {ASSIGNMENTS} SELECT a.record_id, a.topic_id, substr(d.text, 1, 100) AS excerpt FROM assignments a LEFT JOIN documents d ON a.record_id = d.doc_id")
def join_rep_docs(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.substring("text", 1, 100).alias("excerpt"))
    return assignments(spark, sf).select("record_id", "topic_id").join(d, "record_id", "left")


@query("join_topic_review", f"WITH {ASSIGNMENTS}, e AS (SELECT dataset, topic_id FROM assignments WHERE topic_id <> -1 GROUP BY 1, 2) SELECT e.dataset, e.topic_id, CASE WHEN e.topic_id % 2 = 0 THEN 'keep' END AS decision FROM e")
def join_topic_review(spark, sf):
    e = assignments(spark, sf).where("topic_id <> -1").select("dataset", "topic_id").distinct()
    review = e.where("topic_id % 2 = 0").withColumn("decision", F.lit("keep"))
    return R.join_checked(e, review, ["dataset", "topic_id"], "left", "1:1")


@query("join_topic_mapping", f"WITH {ASSIGNMENTS} SELECT record_id, concat('n', CAST(topic_id % 3 AS VARCHAR)) AS narrative_id FROM assignments WHERE topic_id >= 0")
def join_topic_mapping(spark, sf):
    m = spark.createDataFrame([(t, f"n{t % 3}") for t in range(10)], "topic_id int, narrative_id string")
    return assignments(spark, sf).join(F.broadcast(m), "topic_id").select("record_id", "narrative_id")


@query("join_pred_narrative", f"WITH {KEYED}, {ASSIGNMENTS} SELECT k.record_id, k.y, k.pa, a.topic_id FROM keyed k JOIN assignments a ON k.record_id = a.record_id WHERE a.topic_id >= 0")
def join_pred_narrative(spark, sf):
    return R.join_checked(keyed(spark, sf).select("record_id", "y", "pa"), assignments(spark, sf).where("topic_id >= 0").select("record_id", "topic_id"), ["record_id"], validate="m:1")


@query("join_narrative_meta", f"WITH {ASSIGNMENTS} SELECT a.record_id, o.o_totalprice AS value FROM assignments a LEFT JOIN orders o ON a.record_id = o.o_orderkey")
def join_narrative_meta(spark, sf):
    return assignments(spark, sf).select("record_id").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").alias("value")), "record_id", "left")


@query("join_label_align", f"WITH {KEYED} SELECT count(*) AS n, count(*) FILTER (WHERE a.y <> b.y) AS differing FROM keyed a JOIN keyed b ON a.record_id = b.record_id")
def join_label_align(spark, sf):
    k = keyed(spark, sf)
    return k.select("record_id", "y").join(k.select("record_id", F.col("y").alias("yb")), "record_id").agg(F.count("*").alias("n"), F.count_if(F.col("y") != F.col("yb")).alias("differing"))


@query("join_stage_ab", "SELECT c_custkey AS case_id, c_mktsegment AS code_a, c_nationkey AS code_b FROM customer")
def join_stage_ab(spark, sf):
    c = table(spark, sf, "customer")
    return R.join_checked(c.select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("code_a")), c.select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("code_b")), ["case_id"], validate="1:1")


@query("join_family_audit", "SELECT r.r_regionkey, r.r_name, n.nations FROM region r LEFT JOIN (SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1) n ON r.r_regionkey = n.n_regionkey")
def join_family_audit(spark, sf):
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("nations"))
    return table(spark, sf, "region").select("r_regionkey", "r_name").join(n, "r_regionkey", "left")


@query("lookup_map", "SELECT s.s_suppkey, coalesce(n.n_name, 'none') AS nation FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_nationkey < 20")
def lookup_map(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey < 20").withColumnRenamed("n_nationkey", "s_nationkey")
    return R.lookup(table(spark, sf, "supplier"), n, "s_nationkey", "n_name", "nation", "none").select("s_suppkey", "nation")


@query("semi_isin", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_isin(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("anti_isin", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_isin(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("flag_isin", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS flagged FROM customer")
def flag_isin(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.col("hit").isNotNull().alias("flagged"))


@query("union_all", "SELECT c_custkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def union_all(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("kind")).unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("kind")), allowMissingColumns=True)


@query("distinct_subset_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def distinct_subset_first(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("dup_detect", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_detect(spark, sf):
    return R.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("key_set_difference", "SELECT DISTINCT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def key_set_difference(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("k"))
    return R.key_difference(table(spark, sf, "part").select(F.col("p_partkey").alias("k")), li, ["k"])


@query("key_set_equality", "SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) = 0 AND (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) = 0 AS same")
def key_set_equality(spark, sf):
    li, o = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    miss = R.key_difference(li, o, ["k"]).union(R.key_difference(o, li, ["k"]))
    return miss.agg((F.count("*") == 0).alias("same"))


@query("key_set_intersection_union", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT (SELECT count(*) FROM a JOIN b ON a.k = b.k) AS i, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS u) SELECT i AS intersection, u AS total, round(i * 1.0 / u, 6) AS jaccard FROM c")
def key_set_intersection_union(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus IN ('F', 'O')").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderstatus") == "O").alias("b"))
    got = o.agg(F.count_if(F.col("a") & F.col("b")).alias("intersection"), F.count("*").alias("total"))
    return got.withColumn("jaccard", F.round(F.col("intersection") / F.col("total"), 6))


@query("frame_equality", "SELECT true AS same, false AS changed")
def frame_equality(spark, sf):
    n = table(spark, sf, "nation")
    same, changed = R.same_rows(n, n.orderBy(F.desc("n_nationkey"))), R.same_rows(n, n.withColumn("n_name", F.lower("n_name")))
    return spark.createDataFrame([(same, changed)], "same boolean, changed boolean")


@query("strata_set_equality", "WITH t AS (SELECT DISTINCT o_orderstatus FROM orders), s AS (SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY 1) SELECT o_orderpriority, k = (SELECT count(*) FROM t) AS complete FROM s")
def strata_set_equality(spark, sf):
    o = table(spark, sf, "orders")
    every = o.agg(F.array_sort(F.collect_set("o_orderstatus")).alias("every"))
    return o.groupBy("o_orderpriority").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("own")).crossJoin(F.broadcast(every)).select("o_orderpriority", (F.col("own") == F.col("every")).alias("complete"))


@query("win_dup_rank", f"WITH {ITEMS}, h AS (SELECT record_id, dataset, substr(sha1(trim(regexp_replace(lower(body_text), '[^a-z0-9]+', ' ', 'g'))), 1, 16) AS g FROM items) SELECT record_id, row_number() OVER (PARTITION BY dataset, g ORDER BY record_id) - 1 AS dup_rank FROM h")
def win_dup_rank(spark, sf):
    from tessera.functions.text import normalized_text_hash

    d = items(spark, sf).select("record_id", "dataset", normalized_text_hash("body_text").alias("g"))
    return R.rank_within(d, ["dataset", "g"], ["record_id"], "dup_rank", zero=True).select("record_id", F.col("dup_rank").cast("long").alias("dup_rank"))


@query("win_representative_rank", f"WITH {ASSIGNMENTS} SELECT dataset, topic_id, record_id, rn AS representative_rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset, topic_id ORDER BY assigned_probability DESC, record_id) AS rn FROM assignments WHERE topic_id <> -1) WHERE rn <= 5")
def win_representative_rank(spark, sf):
    got = R.rank_within(assignments(spark, sf).where("topic_id <> -1"), ["dataset", "topic_id"], [F.desc("assigned_probability"), "record_id"], "representative_rank")
    return got.where("representative_rank <= 5").select("dataset", "topic_id", "record_id", F.col("representative_rank").cast("long").alias("representative_rank"))


@query("win_balance_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderpriority, sha256(concat('613|', o_orderstatus, '|', CAST(o_orderkey AS VARCHAR)))) - 1 AS balance_rank FROM orders")
def win_balance_rank(spark, sf):
    from tessera.functions.text import seeded_hash

    o = table(spark, sf, "orders").withColumn("h", seeded_hash(613, "o_orderstatus", F.col("o_orderkey").cast("string")))
    return R.rank_within(o, ["o_orderstatus", "o_custkey"], ["o_orderpriority", "h"], "balance_rank", zero=True).select("o_orderkey", F.col("balance_rank").cast("long").alias("balance_rank"))


@query("win_selection_order", "SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey, n_name) AS selection_order FROM nation")
def win_selection_order(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.row_number().over(W.orderBy("n_regionkey", "n_name")).cast("long").alias("selection_order"))


@query("win_group_total", f"WITH {ITEMS} SELECT dataset, text_unit, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY dataset), 6) AS share FROM items GROUP BY 1, 2")
def win_group_total(spark, sf):
    g = items(spark, sf).groupBy("dataset", "text_unit").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("dataset")), 6))


@query("win_ntile_equal_mass", f"WITH {KEYED} SELECT record_id, CAST(ntile(10) OVER (ORDER BY score_a, record_id) - 1 AS INTEGER) AS bin FROM keyed")
def win_ntile_equal_mass(spark, sf):
    from tessera.operators.evaluation import equal_mass_bins

    return equal_mass_bins(keyed(spark, sf).withColumn("score", F.col("score_a")), ["record_id"]).select("record_id", "bin")


@query("win_ecdf", "WITH s AS (SELECT l_quantity AS x, count(*) AS c FROM lineitem GROUP BY 1) SELECT x, round(sum(c) OVER (ORDER BY x) * 1.0 / sum(c) OVER (), 6) AS f FROM s")
def win_ecdf(spark, sf):
    from tessera.operators.shift import ecdf

    return ecdf(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x")), "x").select("x", F.round("f", 6).alias("f"))


@query("sort_multi_key", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY o_orderpriority, n DESC")
def sort_multi_key(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).orderBy("o_orderpriority", F.desc("n"), "o_orderstatus")


@query("topk_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_head(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("topk_per_direction", "WITH v AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS c FROM events), r AS (SELECT user_id, event_id, c > 0 AS positive, row_number() OVER (PARTITION BY user_id, c > 0 ORDER BY abs(c) DESC, event_id) AS rn FROM v WHERE c <> 0) SELECT user_id, event_id, positive, rn FROM r WHERE rn <= 3")
def topk_per_direction(spark, sf):
    from tessera.operators.explain import top_by_sign

    v = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value")).alias("contribution"))
    return top_by_sign(v, ["user_id"], "event_id", 3).select("user_id", "event_id", "positive", F.col("rn").cast("long").alias("rn"))


@query("topk_abs", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY abs(value) DESC, event_id) AS rn FROM events) SELECT user_id, event_id FROM r WHERE rn <= 5")
def topk_abs(spark, sf):
    return R.rank_within(table(spark, sf, "events"), ["user_id"], [F.abs("value").desc(), "event_id"]).where("rank <= 5").select("user_id", "event_id")


@query("topk_nlargest_sum", "WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT n FROM g ORDER BY n DESC LIMIT 5) SELECT round((SELECT sum(n) FROM t) * 1.0 / (SELECT sum(n) FROM g), 6) AS top5_share")
def topk_nlargest_sum(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    top = g.orderBy(F.desc("n")).limit(5).agg(F.sum("n").alias("t"))
    return g.agg(F.sum("n").alias("n")).crossJoin(top).select(F.round(F.col("t") / F.col("n"), 6).alias("top5_share"))


@query("kth_smallest", "SELECT o_totalprice AS v FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) AS rn FROM orders) WHERE rn = 100")
def kth_smallest(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_totalprice").alias("v")).orderBy("v").limit(100).agg(F.max("v").alias("v"))


@query("argmax_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def argmax_first(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("argmin_two_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def argmin_two_key(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("topic_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS dominant FROM embeddings")
def topic_argmax(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")).cast("int") - 1).alias("dominant"))


@query("key_equality_self_join", f"WITH {TITLES} SELECT title, count(*) AS pages, min(page_id) AS owner FROM titles WHERE title <> '' GROUP BY 1 HAVING count(*) > 1")
def key_equality_self_join(spark, sf):
    return titles(spark, sf).where("title <> ''").groupBy("title").agg(F.count("*").alias("pages"), F.min("page_id").alias("owner")).where("pages > 1")
