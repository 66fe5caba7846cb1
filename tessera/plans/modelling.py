"""TF-IDF, linear models, explanations, clustering over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import experiments as E
from tessera.operators import explain as X
from tessera.operators import features as V
from tessera.operators import models as M
from tessera.plans.adapters import ITEMS, KEYED, PREDS, engagement, items, keyed, predictions, table
from tessera.plans.registry import query
from tessera.runtime import Workspace

TOK = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents), tc AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2)"


def whole(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), "text")


@query("term_counts", f"WITH {TOK} SELECT doc_id AS record_id, term, tf FROM tc")
def term_counts(spark, sf):
    return V.term_counts(whole(spark, sf), "text")


@query("tfidf_vocabulary", f"WITH {TOK} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tc GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 1000")
def tfidf_vocabulary(spark, sf):
    return V.vocabulary(V.term_counts(whole(spark, sf), "text"), 2, 1000)


TFIDF = f"{TOK}, n AS (SELECT count(*) AS n FROM documents), v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tc GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 1000), w AS (SELECT tc.doc_id, tc.term, (1 + ln(tc.tf)) * (ln((1.0e0 + n.n) / (1 + v.df)) + 1) AS x FROM tc JOIN v ON tc.term = v.term CROSS JOIN n)"


def tfidf_of(spark, sf):
    """TF-IDF of the documents and its vocabulary, of 1,000 terms."""
    d = whole(spark, sf)
    c = V.term_counts(d, "text")
    vocab = Workspace(spark).keep(V.vocabulary(c, 2, 1000), "vocabulary")
    return V.tfidf(c, F.broadcast(vocab), d.count(), sublinear=True), vocab


_WORDS_AND_PAIRS = """ws AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents), tok AS (SELECT doc_id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1])))) AS term FROM ws),
    tc AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), v AS (SELECT term, count(*) AS df FROM tc GROUP BY 1 HAVING count(*) >= 2), w AS (SELECT tc.doc_id, tc.term, (1 + ln(tc.tf)) * (ln((1.0e0 + n.n) / (1 + v.df)) + 1) AS x FROM tc JOIN v ON tc.term = v.term CROSS JOIN n)"""


@query("tfidf", f"WITH {_WORDS_AND_PAIRS} SELECT doc_id AS record_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w")
def tfidf(spark, sf):
    """Words and word pairs without accents; every term of two documents or more."""
    ws = Workspace(spark)
    d = whole(spark, sf).withColumn("text", T.strip_accents(F.lower("text")))
    c = ws.keep(V.term_counts(d, "text", bigrams=True), "counts")
    vocab = ws.keep(V.vocabulary(c, 2), "vocabulary")
    return V.tfidf(c, vocab, d.count(), sublinear=True, large=True).withColumn("tfidf", F.round("tfidf", 6))


@query("explain_linear", f"WITH {TFIDF}, f AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS tfidf FROM w) SELECT doc_id AS record_id, round(sum(tfidf * (length(term) - 5) / 10.0e0) + 0.25, 6) AS score FROM f GROUP BY 1")
def explain_linear(spark, sf):
    t, vocab = tfidf_of(spark, sf)
    w = vocab.select("term", ((F.length("term") - 5) / 10.0).alias("weight"))
    return X.reconstruct(X.contributions(t, F.broadcast(w)), 0.25).select("record_id", F.round("score", 6).alias("score"))


@query("topk_coeff", f"WITH {TOK}, v AS (SELECT term, count(*) AS df FROM tc GROUP BY 1), a AS (SELECT term, df FROM v ORDER BY df DESC, term LIMIT 50), b AS (SELECT term, df FROM v ORDER BY df, term LIMIT 50) SELECT 'high' AS side, term, df FROM a UNION ALL SELECT 'low', term, df FROM b")
def topk_coeff(spark, sf):
    v = V.vocabulary(V.term_counts(whole(spark, sf), "text")).select("term", "df")
    hi, lo = v.orderBy(F.desc("df"), "term").limit(50), v.orderBy("df", "term").limit(50)
    return hi.select(F.lit("high").alias("side"), "term", "df").union(lo.select(F.lit("low").alias("side"), "term", "df"))


@query(
    "explain_stability",
    """WITH e AS (SELECT user_id, event_type AS feature, sum(CASE WHEN event_id % 2 = 0 THEN value END) AS ca, sum(CASE WHEN event_id % 3 = 0 THEN -value ELSE NULL END) AS cb FROM events GROUP BY 1, 2), f AS (SELECT * FROM e WHERE ca IS NOT NULL OR cb IS NOT NULL)
    SELECT user_id, round(1.0 * count(*) FILTER (WHERE ca IS NOT NULL AND cb IS NOT NULL) / count(*), 6) AS jaccard, round(avg(CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN CASE WHEN sign(ca) = sign(cb) THEN 1.0 ELSE 0.0 END END), 6) AS sign_agreement,
    round(CASE WHEN sqrt(sum(ca * ca)) * sqrt(sum(cb * cb)) = 0 THEN NULL ELSE coalesce(sum(ca * cb), 0) / (sqrt(sum(ca * ca)) * sqrt(sum(cb * cb))) END, 6) AS cosine FROM f GROUP BY 1""",
)
def explain_stability(spark, sf):
    e = table(spark, sf, "events")
    a = e.where("event_id % 2 = 0").groupBy("user_id", F.col("event_type").alias("feature")).agg(F.sum("value").alias("contribution"))
    b = e.where("event_id % 3 = 0").groupBy("user_id", F.col("event_type").alias("feature")).agg(F.sum(-F.col("value")).alias("contribution"))
    return X.stability(a, b, ["user_id"])


@query("refit_verify", f"WITH {KEYED} SELECT avg(CASE WHEN pa = pb THEN 1.0e0 ELSE 0 END) AS agreement, max(abs(score_a - score_b)) AS max_gap, avg(CASE WHEN pa = pb THEN 1.0e0 ELSE 0 END) = 1 AND max(abs(score_a - score_b)) <= 1e-5 AS verified FROM keyed")
def refit_verify(spark, sf):
    k = keyed(spark, sf)
    return X.refit_agreement(*(k.select("record_id", F.col(p).alias("p"), F.col(s).alias("score")) for p, s in (("pa", "score_a"), ("pb", "score_b"))))


@query("refit_reproduces")
def refit_reproduces(spark, sf):
    """The model fitted again on the same rows in another order and other partitions, against the first."""
    train, _, test = parts(labelled(spark, sf))
    a = E.fit(train, E.PLAIN).predict(test)
    b = E.fit(train.repartition(5, "record_id"), E.PLAIN).predict(test)
    return X.refit_agreement(*(x.select("record_id", "p", "score") for x in (a, b)))


@query("majority", "SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def majority(spark, sf):
    return spark.createDataFrame([(M.fit_majority(predictions(spark, sf)),)], "label int")


GRID = "grid AS (SELECT row_number() OVER (ORDER BY m, d DESC, s) - 1 AS i, m, d, s FROM (SELECT unnest([10000, 20000]) AS m) CROSS JOIN (SELECT unnest([2, 5]) AS d) CROSS JOIN (SELECT unnest([false, true]) AS s))"


@query("tfidf_grid", f"WITH {GRID} SELECT CAST(i AS INTEGER) AS i, CAST(m AS INTEGER) AS max_features, CAST(d AS INTEGER) AS min_df, s AS sublinear, CAST(1 AS INTEGER) AS ngram_min, CAST(2 AS INTEGER) AS ngram_max FROM grid")
def tfidf_grid(spark, sf):
    rows = [(i, g["max_features"], g["min_df"], g["sublinear"], *g["ngrams"]) for i, g in enumerate(V.grid())]
    return spark.createDataFrame(rows, "i int, max_features int, min_df int, sublinear boolean, ngram_min int, ngram_max int")


@query("candidates", f"WITH {GRID} SELECT 'majority' AS model, CAST(-1 AS BIGINT) AS i, 0.0e0 AS c UNION ALL SELECT model, i, CAST(c AS DOUBLE) FROM grid CROSS JOIN (SELECT unnest(['logistic_regression', 'linear_svm']) AS model) CROSS JOIN (SELECT unnest([0.1, 1.0, 10.0]) AS c)")
def candidates(spark, sf):
    grid = V.grid()
    rows = [(c["model"], grid.index(c["representation"]) if "representation" in c else -1, float(c.get("c", 0.0))) for c in V.candidates()]
    return spark.createDataFrame(rows, "model string, i long, c double")


def labelled(spark, sf):
    """Labelled documents, without capitals and accents; every fifth one is for the test, the one before it for validation."""
    d = items(spark, sf).where("harmonized_label IS NOT NULL").select("record_id", T.strip_accents(F.lower("body_text")).alias("text"), F.when(F.col("harmonized_label") == "unreliable", 1).otherwise(0).alias("y"), "source_name", "dataset", "n_chars", F.col("doc_id").alias("grp"))
    k = F.pmod("grp", F.lit(5))
    return d.withColumn("split", F.when(k == 4, "test").when(k == 3, "validation").otherwise("train"))


def parts(df):
    return (df.where(F.col("split") == s) for s in ("train", "validation", "test"))


@query("logistic_regression")
def logistic_regression(spark, sf):
    train, _, test = parts(labelled(spark, sf))
    return E.fit(train, E.PLAIN).predict(test)


@query("linear_svm")
def linear_svm(spark, sf):
    train, _, test = parts(labelled(spark, sf))
    return E.fit(train, E.PLAIN | dict(model="linear_svm")).predict(test)


@query("select_on_validation")
def select_on_validation(spark, sf):
    train, validation, test = parts(labelled(spark, sf))
    got, _ = E.select_on_validation(train, validation, V.candidates())
    return got.predict(test).withColumn("model", F.lit(got.spec["model"]))


@query("tuning_report")
def tuning_report(spark, sf):
    train, validation, _ = parts(labelled(spark, sf))
    specs = V.candidates()
    return E.tuning_report(spark, specs, E.search(train, validation, specs)[0])


def controlled(spark, sf):
    """Labelled documents in groups of fifty neighbouring ids, for group-disjoint allocations."""
    d = labelled(spark, sf).drop("split")
    return d.withColumns({"grp": F.floor(F.col("grp") / 50), "harmonized_label": F.when(F.col("y") == 1, "unreliable").otherwise("reliable"), "text_unit": F.when(F.col("n_chars") < 1000, "claim").otherwise("article")})


ON_TEXT = [("majority", "text", "majority"), ("logistic_regression", "text", "logistic_regression"), ("linear_svm", "text", "linear_svm")]
DIAGNOSTIC = ("publisher", "unit", "length", "title", "body")


@query("text_baseline_matrix")
def text_baseline_matrix(spark, sf):
    """Splits by row, by group, by hosting domain, and with masked text; text models, and logistic ones of the publisher, unit, length, title or body alone.

    Documents have no date, so there is no temporal split. Titles are the first words, bodies the rest.
    """
    from tessera.operators.splits import group_disjoint_split

    lengths = F.floor(F.log2(F.size(F.split(F.trim("text"), r"\s+")) + 1))
    d = controlled(spark, sf).withColumns({"domain": F.concat_ws("-", "source_name", F.pmod(F.expr("CAST(substr(record_id, 5) AS LONG)"), F.lit(40))), "masked": T.mask_artifacts("text", "source_name"), "publisher": F.concat(F.lit("publisher_"), F.coalesce("source_name", F.lit("missing"))), "unit": F.concat(F.lit("unit_"), "text_unit"), "length": F.concat(F.lit("length_bin_"), lengths), "title": F.substring("text", 1, 80), "body": F.expr("substr(text, 81)")})
    d = Workspace(spark).keep(d, "labelled")
    standard = d.join(labelled(spark, sf).select("record_id", "split"), "record_id")
    splits = {"standard": standard, "group_disjoint": group_disjoint_split(d, "grp", 500), "domain_disjoint": group_disjoint_split(d, "domain", 500), "masked": standard}
    plans = {name: ON_TEXT + [(f"{c}_only_logistic", c, "logistic_regression") for c in DIAGNOSTIC] for name in splits} | {"masked": [(m, "masked", k) for m, _, k in ON_TEXT]}
    return E.baseline_matrix(splits, V.candidates(), plans=plans)


@query("repeat_sensitivity")
def repeat_sensitivity(spark, sf):
    return E.repeat_sensitivity(controlled(spark, sf), "grp", repeats=10, attempts=100)


@query("repeat_summary")
def repeat_summary(spark, sf):
    return E.repeat_summary(repeat_sensitivity(spark, sf))


@query("transfer_run")
def transfer_run(spark, sf):
    d = labelled(spark, sf).withColumn("domain", F.concat_ws("/", "dataset", "source_name"))
    return E.transfer_run(d.where("dataset = 'en'"), d.where("dataset <> 'en'"), "domain")


@query("transfer_summary")
def transfer_summary(spark, sf):
    return E.transfer_summary(transfer_run(spark, sf))


@query("engagement_ablation")
def engagement_ablation(spark, sf):
    """Documents with engagement alone, by row and by group; a split without rows of both classes to learn from, or without others, is left out."""
    from tessera.operators.splits import group_disjoint_split

    counts = ["tweet_count", "reply_count", "retweet_count"]
    e = engagement(spark, sf).groupBy(F.col("user_id").alias("doc_id")).agg(*[F.sum(c).alias(c) for c in counts]).where(" + ".join(counts) + " > 0")
    e = e.select(F.concat(F.lit("doc_"), "doc_id").alias("record_id"), *counts)
    out = None
    for name, rows in (("standard", labelled(spark, sf)), ("group_disjoint", group_disjoint_split(controlled(spark, sf), "grp", 500))):
        d = Workspace(spark).keep(rows.join(e, "record_id").select("record_id", "y", "split", "text", *counts), name)
        held = {(r["split"], r["y"]) for r in d.select("split", "y").distinct().collect()}
        if {("train", 0), ("train", 1)} <= held and {"validation", "test"} <= {s for s, _ in held}:
            got = E.engagement_ablation(d, counts).withColumn("split_name", F.lit(name))
            out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "arm string, c double, record_id string, y int, p int, score double, split_name string")


@query("calibrator_platt")
def calibrator_platt(spark, sf):
    a, b = M.platt(predictions(spark, sf))
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "intercept double, slope double")


@query(
    "calibrator_isotonic",
    f"""WITH {PREDS}, g AS (SELECT score, count(*) AS n, sum(y) AS k FROM preds GROUP BY 1), r AS (SELECT a.score AS lo, b.score AS hi, 1.0e0 * sum(g.k) / sum(g.n) AS v FROM g a JOIN g b ON a.score <= b.score JOIN g ON g.score BETWEEN a.score AND b.score GROUP BY 1, 2),
    low AS (SELECT g.score, r.lo, min(r.v) AS v FROM g JOIN r ON r.lo <= g.score AND r.hi >= g.score GROUP BY 1, 2), fit AS (SELECT score, max(v) AS v FROM low GROUP BY 1)
    SELECT min(fit.score) AS from_score, CAST(sum(n) AS BIGINT) AS n, v AS value FROM (SELECT score, round(v, 9) AS v FROM fit) fit JOIN g ON g.score = fit.score GROUP BY v""",
)
def calibrator_isotonic(spark, sf):
    from tessera.operators.isotonic import isotonic

    return isotonic(predictions(spark, sf)).withColumn("value", F.round("value", 9))


@query("bertopic_clusters")
def bertopic_clusters(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return M.cluster_topics(e)


@query("calibration_partition", f"WITH {PREDS}, g AS (SELECT DISTINCT grp FROM preds) SELECT grp, substr(sha1(concat('613|', CAST(grp AS VARCHAR))), 1, 1) < '8' AS fit FROM g")
def calibration_partition(spark, sf):
    g = predictions(spark, sf).select("grp").distinct()
    return g.select("grp", (F.substring(F.sha1(F.concat_ws("|", F.lit("613"), F.col("grp").cast("string")).cast("binary")), 1, 1) < "8").alias("fit"))


@query("sink_json_strict", f"WITH {KEYED} SELECT record_id, CASE WHEN y = 1 THEN score_a END AS score FROM keyed")
def sink_json_strict(spark, sf):
    from tessera.sources.sinks import strict

    k = keyed(spark, sf).select("record_id", F.when(F.col("y") == 1, F.col("score_a")).otherwise(F.lit(float("nan"))).alias("score"))
    return strict(k)


@query("topic_proxy")
def topic_proxy(spark, sf):
    from tessera.operators.shift import topic_mix
    from tessera.operators.topics import topic_proxy

    d = items(spark, sf).select("record_id", F.when(F.col("dataset") == "en", 0).otherwise(1).alias("side"), F.col("body_text").alias("text"))
    mixtures, _ = topic_proxy(d, "side")
    return topic_mix(mixtures, "weights", "side")


def cohorts(spark, sf):
    """Source: English documents; target: the others. Titles are the first words, domains a source's sections, few of which both have."""
    d = items(spark, sf).withColumns({"model_text": F.col("body_text"), "title": F.substring("body_text", 1, 80), "publisher_id": F.col("source_name"), "source_domain": F.concat_ws("-", "source_name", F.when(F.col("dataset") == "en", F.col("doc_id") % 40).otherwise(F.col("doc_id") % 90))})
    return d.where("dataset = 'en'"), d.where("dataset <> 'en'")


def bundle(spark, sf, **options):
    from tessera.operators.bundle import shift_bundle

    source, target = cohorts(spark, sf)
    return shift_bundle(source, target, source, source_name="en", target_name="other", **options)


# the same sides and counts in SQL: x marks target records on a domain of the source
_COHORTS = f"""{ITEMS}, c AS (SELECT record_id, harmonized_label, text_unit, source_name AS publisher_id, concat(source_name, '-', CAST(CASE WHEN dataset = 'en' THEN doc_id % 40 ELSE doc_id % 90 END AS VARCHAR)) AS source_domain, body_text AS model_text, substr(body_text, 1, 80) AS title, dataset = 'en' AS src FROM items),
    r AS (SELECT *, CASE WHEN src THEN 0 WHEN source_domain IN (SELECT source_domain FROM c WHERE src) THEN 2 ELSE 1 END AS side FROM c), sizes AS (SELECT count(*) FILTER (WHERE side = 0) AS ns, count(*) FILTER (WHERE side = 1) AS nt, count(*) FILTER (WHERE side = 2) AS nx FROM r)"""
_CATS = f"""{_COHORTS}, cat AS (SELECT field, coalesce(nullif(trim(value), ''), '(missing)') AS value, side FROM (SELECT side, unnest(['harmonized_label', 'text_unit', 'publisher_id', 'source_domain']) AS field, unnest([harmonized_label, text_unit, publisher_id, source_domain]) AS value FROM r)),
    k AS (SELECT field, value, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t, count(*) FILTER (WHERE side = 2) AS x FROM cat GROUP BY 1, 2)"""
_WORDS = f"""{_COHORTS}, w AS (SELECT side, unnest(['full_text', 'title_only']) AS text_representation, unnest([regexp_extract_all(lower(model_text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]{{2,}}')]) AS ws FROM r WHERE side < 2)"""
_TERMS = f"""{_WORDS}, n AS (SELECT text_representation, term, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM (SELECT side, text_representation, unnest(ws) AS term FROM w) GROUP BY 1, 2),
    top AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY text_representation ORDER BY s + t DESC, term) <= 20000),
    p AS (SELECT *, sum(s) OVER g AS ss, sum(t) OVER g AS tt, count(*) OVER g AS v, 1e0 * s / sum(s) OVER g AS ps, 1e0 * t / sum(t) OVER g AS pt FROM top WINDOW g AS (PARTITION BY text_representation))"""
_JS = "round(sum(0.5 * CASE WHEN ps > 0 THEN ps * log2(ps / ((ps + pt) / 2)) ELSE 0 END + 0.5 * CASE WHEN pt > 0 THEN pt * log2(pt / ((ps + pt) / 2)) ELSE 0 END), 6)"
_DIR = "'en_to_other' AS direction"


def _profile_row(cohort: str, dataset: str, side: str, total: str) -> str:
    label = lambda v: f"CAST(coalesce(sum(CASE WHEN field = 'harmonized_label' AND value = '{v}' THEN {side} END), 0) AS BIGINT)"
    has = lambda f: f"count(*) FILTER (WHERE field = '{f}' AND {side} > 0)"
    return f"SELECT {_DIR}, '{cohort}' AS cohort, '{dataset}' AS dataset, (SELECT {total} FROM sizes) AS records, {label('reliable')} AS reliable_records, {label('unreliable')} AS unreliable_records, round({label('unreliable')} * 1e0 / (SELECT {total} FROM sizes), 6) AS unreliable_prevalence, {has('text_unit')} AS text_units, {has('publisher_id')} AS publishers, {has('source_domain')} AS source_domains FROM k"


@query("shift_cohort_profiles", f"WITH {_CATS} " + " UNION ALL ".join((_profile_row("source_train", "en", "s", "ns"), _profile_row("target_test_before_domain_exclusion", "other", "(t + x)", "(nt + nx)"), _profile_row("target_test_after_domain_exclusion", "other", "t", "nt"))))
def shift_cohort_profiles(spark, sf):
    return bundle(spark, sf)["cohort_profiles"]


@query(
    "shift_domain_exclusion",
    f"""WITH {_CATS}, d AS (SELECT * FROM k WHERE field = 'source_domain') SELECT {_DIR}, (SELECT count(*) FROM d WHERE s > 0 AND value <> '(missing)') AS source_domain_reference_count, (SELECT nt + nx FROM sizes) AS target_records_before_exclusion, (SELECT nt FROM sizes) AS target_records_after_exclusion, (SELECT nx FROM sizes) AS target_records_removed,
    round((SELECT 1e0 * nx / (nt + nx) FROM sizes), 6) AS target_record_removal_share, count(*) FILTER (WHERE t + x > 0) AS target_domains_before_exclusion, count(*) FILTER (WHERE t > 0) AS target_domains_after_exclusion, count(*) FILTER (WHERE x > 0) AS target_domains_removed, CAST(0 AS BIGINT) AS remaining_target_records_on_exclusion_domains FROM d""",
)
def shift_domain_exclusion(spark, sf):
    return bundle(spark, sf)["domain_exclusion_summary"]


@query(
    "shift_vocabulary_summary",
    f"""WITH {_TERMS} SELECT {_DIR}, text_representation, count(*) AS retained_vocabulary_terms, CAST(max(ss) AS BIGINT) AS source_retained_tokens, CAST(max(tt) AS BIGINT) AS target_retained_tokens, count(*) FILTER (WHERE s >= 2) AS source_active_types, count(*) FILTER (WHERE t >= 2) AS target_active_types, count(*) FILTER (WHERE s >= 2 AND t >= 2) AS shared_active_types,
    round(1e0 * count(*) FILTER (WHERE s >= 2 AND t >= 2) / count(*) FILTER (WHERE s >= 2 OR t >= 2), 6) AS active_type_jaccard, round(1e0 * count(*) FILTER (WHERE s >= 2 AND t >= 2) / count(*) FILTER (WHERE t >= 2), 6) AS target_active_type_coverage_by_source,
    round(1e0 * sum(CASE WHEN s >= 2 THEN t ELSE 0 END) / max(tt), 6) AS target_token_coverage_by_source_active_types, round(1e0 * sum(CASE WHEN t >= 2 THEN s ELSE 0 END) / max(ss), 6) AS source_token_coverage_by_target_active_types, {_JS} AS jensen_shannon_divergence_bits_retained_vocabulary FROM p GROUP BY text_representation""",
)
def shift_vocabulary_summary(spark, sf):
    return bundle(spark, sf)["vocabulary_summary"]


_ENRICHED = """SELECT 'en_to_other' AS direction, text_representation, '{name}' AS enrichment, CAST(rank AS INTEGER) AS rank, term, s AS source_count, round(ps, 9) AS source_share, t AS target_count, round(pt, 9) AS target_share, round(delta, 9) AS target_minus_source_share,
    round(log2(((t + 0.5) / (tt + 0.5 * v)) / ((s + 0.5) / (ss + 0.5 * v))), 6) AS target_to_source_log2_ratio_smoothed FROM (SELECT *, row_number() OVER (PARTITION BY text_representation ORDER BY delta {order}, term) AS rank FROM (SELECT *, round(pt - ps, 12) AS delta FROM p WHERE s + t >= 2)) WHERE rank <= 25"""


@query("shift_vocabulary_terms", f"WITH {_TERMS} " + _ENRICHED.format(name="source_enriched", order="ASC") + " UNION ALL " + _ENRICHED.format(name="target_enriched", order="DESC"))
def shift_vocabulary_terms(spark, sf):
    return bundle(spark, sf)["vocabulary_shift_terms"]


@query(
    "shift_length_profiles",
    f"""WITH {_WORDS}, l AS (SELECT text_representation, CASE WHEN side = 0 THEN 'source_train' ELSE 'target_test_after_domain_exclusion' END AS cohort, CAST(len(ws) AS BIGINT) AS n FROM w)
    SELECT {_DIR}, text_representation, cohort, count(*) AS records, round(1e0 * count(*) FILTER (WHERE n = 0) / count(*), 6) AS empty_document_share, round(avg(n), 6) AS mean_tokens, round(stddev_samp(n), 5) AS standard_deviation_tokens, min(n) AS minimum_tokens,
    {", ".join(f"round(quantile_cont(n, {q}), 6) AS {p}_tokens" for p, q in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9)))}, max(n) AS maximum_tokens FROM l GROUP BY text_representation, cohort""",
)
def shift_length_profiles(spark, sf):
    return bundle(spark, sf)["document_length_profiles"]


@query(
    "shift_length_shift",
    f"""WITH {_WORDS}, l AS (SELECT text_representation AS rep, side, len(ws) AS n FROM w), m AS (SELECT rep, avg(n) FILTER (WHERE side = 0) AS ms, avg(n) FILTER (WHERE side = 1) AS mt, quantile_cont(n, 0.5) FILTER (WHERE side = 0) AS ds, quantile_cont(n, 0.5) FILTER (WHERE side = 1) AS dt,
    count(*) FILTER (WHERE side = 0) AS cs, count(*) FILTER (WHERE side = 1) AS ct, var_samp(n) FILTER (WHERE side = 0) AS vs, var_samp(n) FILTER (WHERE side = 1) AS vt FROM l GROUP BY 1),
    g AS (SELECT rep, n, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM l GROUP BY 1, 2), u AS (SELECT rep, max(gap) AS ks FROM (SELECT rep, abs(1e0 * sum(s) OVER (PARTITION BY rep ORDER BY n) / sum(s) OVER (PARTITION BY rep) - 1e0 * sum(t) OVER (PARTITION BY rep ORDER BY n) / sum(t) OVER (PARTITION BY rep)) AS gap FROM g) GROUP BY 1)
    SELECT {_DIR}, m.rep AS text_representation, round(mt - ms, 6) AS target_minus_source_mean_tokens, round(mt / ms, 6) AS target_to_source_mean_ratio, round(dt - ds, 6) AS target_minus_source_median_tokens, round(dt / ds, 6) AS target_to_source_median_ratio,
    round((mt - ms) / sqrt(((cs - 1) * vs + (ct - 1) * vt) / (cs + ct - 2)), 6) AS standardized_mean_difference_target_minus_source, round(ks, 6) AS kolmogorov_smirnov_statistic FROM m JOIN u ON m.rep = u.rep""",
)
def shift_length_shift(spark, sf):
    return bundle(spark, sf)["document_length_shift"]


_SHARES = f"{_CATS}, p AS (SELECT field, value, s, t, 1e0 * s / (SELECT ns FROM sizes) AS ps, 1e0 * t / (SELECT nt FROM sizes) AS pt FROM k WHERE s + t > 0)"


@query("shift_categorical_distributions", f"WITH {_SHARES} SELECT {_DIR}, field, value AS category, s AS source_count, round(ps, 6) AS source_share, t AS target_count, round(pt, 6) AS target_share, round(pt - ps, 6) AS target_minus_source_share FROM p")
def shift_categorical_distributions(spark, sf):
    return bundle(spark, sf)["categorical_distributions"]


_SUMMARY = f"""cs AS (SELECT field, count(*) FILTER (WHERE s > 0) AS source_unique_categories, count(*) FILTER (WHERE t > 0) AS target_unique_categories, count(*) FILTER (WHERE s > 0 AND t > 0) AS shared_categories, round(1e0 * count(*) FILTER (WHERE s > 0 AND t > 0) / count(*), 6) AS category_jaccard,
    round(sum(CASE WHEN s > 0 THEN pt ELSE 0 END), 6) AS target_record_share_in_source_categories, round(sum(CASE WHEN t > 0 THEN ps ELSE 0 END), 6) AS source_record_share_in_target_categories, round(0.5 * sum(abs(ps - pt)), 6) AS total_variation_distance, {_JS} AS jensen_shannon_divergence_bits,
    round(max(ps), 6) AS source_top1_share, round(max(pt), 6) AS target_top1_share, round(sum(ps) FILTER (WHERE rs <= 5), 6) AS source_top5_share, round(sum(pt) FILTER (WHERE rt <= 5), 6) AS target_top5_share, round(sum(ps * ps), 6) AS source_hhi, round(sum(pt * pt), 6) AS target_hhi,
    round(1 / sum(ps * ps), 6) AS source_effective_category_count, round(1 / sum(pt * pt), 6) AS target_effective_category_count, round(coalesce(sum(ps) FILTER (WHERE value = '(missing)'), 0), 6) AS source_missing_share, round(coalesce(sum(pt) FILTER (WHERE value = '(missing)'), 0), 6) AS target_missing_share,
    round(CASE WHEN field = 'harmonized_label' THEN coalesce(sum(ps) FILTER (WHERE value = 'unreliable'), 0) END, 6) AS source_unreliable_prevalence, round(CASE WHEN field = 'harmonized_label' THEN coalesce(sum(pt) FILTER (WHERE value = 'unreliable'), 0) END, 6) AS target_unreliable_prevalence,
    round(CASE WHEN field = 'harmonized_label' THEN coalesce(sum(pt) FILTER (WHERE value = 'unreliable'), 0) - coalesce(sum(ps) FILTER (WHERE value = 'unreliable'), 0) END, 6) AS target_minus_source_unreliable_prevalence
    FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY ps DESC) AS rs, row_number() OVER (PARTITION BY field ORDER BY pt DESC) AS rt FROM p) GROUP BY field)"""


@query("shift_categorical_summary", f"WITH {_SHARES}, {_SUMMARY} SELECT {_DIR}, * FROM cs")
def shift_categorical_summary(spark, sf):
    return bundle(spark, sf)["categorical_shift_summary"]


@query("shift_bundle")
def shift_bundle(spark, sf):
    return bundle(spark, sf)["shift_summary"]


@query("shift_topic_distributions")
def shift_topic_distributions(spark, sf):
    return bundle(spark, sf)["topic_proxy_distributions"]


_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0e0 * tp / (2 * tp + fp + fn) END"
_F0 = "CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2.0e0 * tn / (2 * tn + fp + fn) END"


def _bag(p: str) -> str:
    c = lambda y, v: f"count(*) FILTER (WHERE y = {y} AND {p} = {v})"
    counts = f"(SELECT {c(1, 1)} AS tp, {c(0, 1)} AS fp, {c(1, 0)} AS fn, {c(0, 0)} AS tn FROM keyed)"
    return f"(SELECT unnest(['macro_f1', 'unreliable_f1', 'unreliable_recall']) AS metric, unnest([({_F1} + {_F0}) / 2, {_F1}, CASE WHEN tp + fn = 0 THEN 0 ELSE 1.0e0 * tp / (tp + fn) END]) AS x FROM {counts})"


_DEGRADED = f"WITH {KEYED}, a AS {_bag('pa')}, b AS {_bag('pb')}, d AS (SELECT a.metric, round(a.x, 6) AS in_domain, round(b.x, 6) AS transfer, round(b.x - a.x, 6) AS delta FROM a JOIN b ON a.metric = b.metric)"


@query("transfer_degradation", f"{_DEGRADED} SELECT * FROM d")
def transfer_degradation(spark, sf):
    return transfer_degradation_rows(spark, sf).where("metric <> 'pr_auc'").select("metric", "in_domain", "transfer", "delta")


@query("transfer_macro_f1", f"{_DEGRADED} SELECT in_domain, transfer, delta FROM d WHERE metric = 'macro_f1'")
def transfer_macro_f1(spark, sf):
    return transfer_degradation_rows(spark, sf).where("metric = 'macro_f1'").select("in_domain", "transfer", "delta")


@query("transfer_degradation_rows")
def transfer_degradation_rows(spark, sf):
    from tessera.operators.transfer import SAME, comparator_spec, degradation

    k = keyed(spark, sf)
    own, base = (k.select("record_id", "y", F.col(p).alias("p"), F.col(s).alias("score")) for p, s in (("pb", "score_b"), ("pa", "score_a")))
    spec = comparator_spec("a", "b", "full_text", "logistic_regression", SAME)
    summary = spark.createDataFrame([(spec.experiment_id, 10, 0.5, 0.5, 0.5, 0.5)], "experiment_id string, n int, macro_f1 double, unreliable_f1 double, unreliable_recall double, pr_auc double")
    got = degradation(own, spec, summary, spec.config(), base)
    return got.select("metric", "status", *[F.round(c, 6).alias(c) for c in ("in_domain", "transfer", "delta", "relative_delta")])
