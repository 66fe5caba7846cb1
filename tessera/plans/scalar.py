"""Scans, projections, filters and scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.adapters import ENGAGEMENT, ITEMS, PAGE_RECORDS, TITLES, ampersand_titles, cleaned_pages, engagement, items, table
from tessera.plans.registry import query

CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
REG = """CASE WHEN len(p) <= 2 THEN h WHEN array_to_string(p[-2:], '.') IN ('ac.uk','co.uk','com.au','com.br','com.cn','com.sg','co.nz','co.za','org.uk')
    THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END"""
HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '')"


@query("scan_parquet", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity < 10")
def scan_parquet(spark, sf):
    return table(spark, sf, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1998-01-01' AND l_quantity < 10").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("scan_manifest_pruned", "SELECT o_orderkey, o_orderstatus FROM orders")
def scan_manifest_pruned(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")


@query("scan_count_sidecar", "SELECT CAST(user_id AS VARCHAR) AS news_id, count(DISTINCT event_type) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1")
def scan_count_sidecar(spark, sf):
    from tessera.sources.items import distinct_counts

    return distinct_counts(table(spark, sf, "events").withColumnRenamed("user_id", "news_id"), "news_id", "event_type")


@query("filter_primary", f"WITH {ITEMS} SELECT record_id, dataset FROM items WHERE harmonized_label IS NOT NULL AND n_chars >= 200")
def filter_primary(spark, sf):
    return items(spark, sf).where("harmonized_label IS NOT NULL AND n_chars >= 200").select("record_id", "dataset")


@query("filter_complete_case", f"WITH {ENGAGEMENT} SELECT user_id, day FROM engagement WHERE engagement_available AND reply_count > 0 AND user_id % 2 = 0")
def filter_complete_case(spark, sf):
    return engagement(spark, sf).where("engagement_available AND reply_count > 0 AND user_id % 2 = 0").select("user_id", "day")


@query("filter_nonblank_group", "SELECT doc_id FROM documents WHERE trim(coalesce(source, '')) <> ''")
def filter_nonblank_group(spark, sf):
    return table(spark, sf, "documents").where("trim(coalesce(source, '')) <> ''").select("doc_id")


@query("filter_ne_value", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '3-MEDIUM'")
def filter_ne_value(spark, sf):
    return table(spark, sf, "orders").where("o_orderpriority <> '3-MEDIUM'").select("o_orderkey", "o_orderpriority")


@query("project_manifest", f"WITH {ITEMS} SELECT record_id, dataset, harmonized_label, text_unit, source_name, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split, 'standard' AS split_type, 13 AS seed FROM items")
def project_manifest(spark, sf):
    r = F.col("doc_id") % 10
    return items(spark, sf).select("record_id", "dataset", "harmonized_label", "text_unit", "source_name", F.when(r < 6, "train").when(r < 8, "validation").otherwise("test").alias("split"), F.lit("standard").alias("split_type"), F.lit(13).alias("seed"))


@query("derive_literal_prefix", f"WITH {ITEMS}, w AS (SELECT *, len(string_split_regex(trim(body_text), '\\s+')) AS n FROM items WHERE trim(body_text) <> '') SELECT record_id, concat('publisher_', source_name) AS publisher_token, concat('unit_', text_unit) AS unit_token, concat('length_bin_', CAST(length(bin(n + 1)) - 1 AS VARCHAR)) AS length_token FROM w")
def derive_literal_prefix(spark, sf):
    d = items(spark, sf).withColumn("t", F.trim(F.regexp_replace("body_text", r"[ \t\n\f\r\x0b]+", " "))).where("t <> ''")
    n = F.size(F.split("t", " "))
    return d.select("record_id", F.concat(F.lit("publisher_"), "source_name").alias("publisher_token"), F.concat(F.lit("unit_"), "text_unit").alias("unit_token"), F.concat(F.lit("length_bin_"), (F.length(F.bin(n + 1)) - 1).cast("string")).alias("length_token"))


@query("label_from_filename", "SELECT page_id, CASE WHEN contains(url, 'html') THEN 'unreliable' WHEN contains(url, 'http') THEN 'reliable' END AS label FROM pages")
def label_from_filename(spark, sf):
    from tessera.sources.items import label_from_name

    return table(spark, sf, "pages").select("page_id", label_from_name(F.col("url"), unreliable="html", reliable="http").alias("label"))


@query("label_from_rating", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 >= 3 THEN 'reliable' ELSE 'unreliable' END AS label, concat('rating_', CAST(o_orderkey % 6 AS VARCHAR)) AS native_label FROM orders")
def label_from_rating(spark, sf):
    from tessera.sources.items import label_from_rating, rating_label

    r = F.col("o_orderkey") % 6
    return table(spark, sf, "orders").select("o_orderkey", label_from_rating(r).alias("label"), rating_label(r).alias("native_label"))


@query("null_to_value", f"WITH {ITEMS} SELECT record_id, coalesce(harmonized_label, '(missing)') AS label, nullif(source_name, 'src0') AS source_name FROM items")
def null_to_value(spark, sf):
    return items(spark, sf).select("record_id", F.coalesce("harmonized_label", F.lit("(missing)")).alias("label"), F.nullif(F.col("source_name"), F.lit("src0")).alias("source_name"))


@query("numeric_coerce", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def numeric_coerce(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    return table(spark, sf, "events").select("event_id", k.try_cast("double").alias("k"), F.col("event_type").try_cast("double").alias("bad"))


@query("drop_rename_insert_reindex", "SELECT o_orderkey AS record_id, 'v1' AS version, o_orderstatus AS status FROM orders")
def drop_rename_insert_reindex(spark, sf):
    d = table(spark, sf, "orders").drop("o_totalprice", "o_orderdate").withColumnsRenamed({"o_orderkey": "record_id", "o_orderstatus": "status"})
    return d.withColumn("version", F.lit("v1")).select("record_id", "version", "status")


@query("clean_text", f"SELECT doc_id, {CLEAN.format('text')} AS text FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text("text").alias("text"))


@query("clean_title", f"WITH {TITLES} SELECT page_id, {CLEAN.format("replace(title, '&amp;', '&')")} AS title FROM titles")
def clean_title(spark, sf):
    return ampersand_titles(spark, sf).select("page_id", T.clean_text("title").alias("title"))


@query("join_text", f"SELECT doc_id, trim(concat({CLEAN.format('source')}, ' ', {CLEAN.format('text')})) AS text FROM documents")
def join_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.join_text("source", "text").alias("text"))


@query("stable_id", "SELECT doc_id, concat('rec_', substr(sha1(concat(lang, '||', source, '||', CAST(doc_id AS VARCHAR))), 1, 16)) AS id FROM documents")
def stable_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.stable_id("lang", "source", "doc_id").alias("id"))


@query("normalized_text", f"SELECT doc_id, {NORM.format('text')} AS text FROM documents")
def normalized_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalized_text("text").alias("text"))


@query("normalized_text_hash", f"SELECT doc_id, substr(sha1({NORM.format('text')}), 1, 16) AS duplicate_group FROM documents")
def normalized_text_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalized_text_hash("text").alias("duplicate_group"))


@query("domain_from_url", f"SELECT page_id, {HOST} AS domain FROM pages")
def domain_from_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.domain_from_url("url").alias("domain"))


@query("registrable_domain", f"WITH h AS (SELECT page_id, {HOST} AS h FROM pages), s AS (SELECT page_id, h, string_split(h, '.') AS p FROM h) SELECT page_id, {REG} AS domain FROM s")
def registrable_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.registrable_domain("url").alias("domain"))


@query(
    "canonical_article_url",
    f"""WITH u AS (SELECT page_id, {HOST} AS host, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/+$', '') AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
    k AS (SELECT page_id, host, path, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains(['fbclid','gclid','mc_cid','mc_eid','ref','ref_src','source'], string_split(lower(x), '=')[1]))), '&') AS q FROM u)
    SELECT page_id, CASE WHEN host = '' OR path = '' THEN '' ELSE concat('https://', host, path, CASE WHEN q = '' THEN '' ELSE concat('?', q) END) END AS url FROM k""",
)
def canonical_article_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.canonical_article_url("url").alias("url"))


@query(
    "family_group_id",
    f"""WITH {PAGE_RECORDS}
    SELECT page_id, concat('family_', substr(sha1(CASE WHEN u <> '' THEN concat('url||', u) WHEN length(t) >= 20 THEN concat('title||', t) ELSE concat('text||', substr(sha1(w), 1, 16)) END), 1, 16)) AS family FROM pr""",
)
def family_group_id(spark, sf):
    from tessera.operators.linkage import family_group_id

    return cleaned_pages(spark, sf).select("page_id", family_group_id(F.col("url"), F.col("title"), F.col("model_text")).alias("family"))


@query(
    "content_exclusion_reason",
    f"""WITH c AS (SELECT doc_id, {CLEAN.format('text')} AS v FROM documents), n AS (SELECT doc_id, v, {NORM.format('v')} AS m FROM c),
    w AS (SELECT doc_id, substr(v, 1, 800) AS v, m, CASE WHEN m = '' THEN 0 ELSE len(string_split(m, ' ')) END AS k FROM n)
    SELECT doc_id, CASE WHEN length(replace(m, ' ', '')) < 10 THEN 'near_empty_text'
        WHEN k <= 250 AND regexp_matches(v, '(?i)\\baccess denied\\b|\\bcloudflare\\b.*\\brestrict access\\b') THEN 'access_denied_page'
        WHEN k <= 250 AND regexp_matches(v, '(?i)^\\W*403 forbidden\\b') THEN 'forbidden_page'
        WHEN k <= 250 AND regexp_matches(v, '(?i)\\blog in or sign up to view\\b|\\byou must log in to continue\\b') THEN 'login_or_signup_page'
        WHEN k <= 250 AND regexp_matches(v, '(?i)\\bjavascript is disabled in your browser\\b|\\bproceed to legacy twitter\\b|\\bmake sure your browser supports javascript and cookies\\b') THEN 'javascript_disabled_page'
        WHEN k <= 250 AND regexp_matches(v, '(?i)^\\W*(facebook|twitter|instagram|youtube)\\W*$') THEN 'bare_platform_page' ELSE '' END AS reason FROM w""",
)
def content_exclusion_reason(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_exclusion_reason("text").alias("reason"))


@query("mask_artifacts", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)https?://\\S+|www\\.\\S+', ' ', 'g'), concat('(?i)\\b', source, '\\b'), ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def mask_artifacts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.mask_artifacts("text", "source").alias("text"))


TERMS = (r"\blicense\b", r"\bidiot\b", r"\bworthless\b")


@query("count_outcome_terms", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\\blicense\\b')) + len(regexp_extract_all(text, '(?i)\\bidiot\\b')) + len(regexp_extract_all(text, '(?i)\\bworthless\\b')) AS BIGINT) AS hits FROM documents")
def count_outcome_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.count_terms(F.col("text"), TERMS).cast("long").alias("hits"))


FEATURES = ("facebook", "news url", "curl", "Artifact value", "the YouTube channel", "twitters", "health", "open source", "resource", "cloudflare")


@query(
    "is_artifact_feature",
    f"""WITH f AS (SELECT DISTINCT source, list_extract({list(FEATURES)!r}, CAST(doc_id % 10 + 1 AS BIGINT)) AS feature FROM documents)
    SELECT source, feature, len(list_filter(string_split(lower(feature), ' '), lambda w: list_contains(['facebook', 'url', 'artifact', 'youtube', 'source', 'cloudflare'], w))) > 0 AS artifact FROM f""",
)
def is_artifact_feature(spark, sf):
    d = table(spark, sf, "documents").select("source", F.element_at(F.array(*map(F.lit, FEATURES)), (F.col("doc_id") % 10 + 1).cast("int")).alias("feature")).distinct()
    return d.select("source", "feature", T.is_artifact_feature(F.col("feature")).alias("artifact"))


@query("normalize_publisher_name", "SELECT DISTINCT source, trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) AS publisher FROM documents")
def normalize_publisher_name(spark, sf):
    return table(spark, sf, "documents").select("source").distinct().select("source", T.normalize_publisher_name("source").alias("publisher"))


@query(
    "assign_publisher_ids",
    f"WITH h AS (SELECT page_id, {HOST} AS h FROM pages), s AS (SELECT page_id, h, string_split(h, '.') AS p FROM h), d AS (SELECT page_id, {REG} AS domain FROM s) SELECT page_id, concat('publisher_', substr(sha1(concat('pages||domain:', domain)), 1, 16)) AS publisher_id FROM d",
)
def assign_publisher_ids(spark, sf):
    d = table(spark, sf, "pages").select("page_id", "url", F.lit("pages").alias("dataset"), F.lit("").alias("source_name"), F.lit(True).alias("url_named"))
    return T.assign_publisher_ids(d).select("page_id", "publisher_id")


@query("parse_alternate_urls", "SELECT page_id, CASE WHEN page_id % 4 > 0 THEN url END AS first_url, CAST(page_id % 4 AS INTEGER) AS n FROM pages")
def parse_alternate_urls(spark, sf):
    d = table(spark, sf, "pages").withColumn("a", F.when(F.col("page_id") % 3 == 0, F.to_json(F.array_repeat("url", (F.col("page_id") % 4).cast("int")))).otherwise(F.array_join(F.array_repeat("url", (F.col("page_id") % 4).cast("int")), "|")))
    got = d.withColumn("l", T.parse_alternate_urls(F.col("a")))
    return got.select("page_id", F.get("l", F.lit(0)).alias("first_url"), F.size("l").alias("n"))


@query("word_count_unicode", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_''-]*[\\p{L}\\p{N}_])?')) AS BIGINT) AS n FROM documents")
def word_count_unicode(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.word_count_unicode(F.col("text")).cast("long").alias("n"))


@query("sk_token_count", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS BIGINT) AS n FROM documents")
def sk_token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("n"))


@query("latin_fraction", "SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) = 0 THEN 0 ELSE CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS DOUBLE) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) END, 6) AS fraction FROM documents")
def latin_fraction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(T.latin_fraction(F.col("text")), 6).alias("fraction"))


@query("unicode_replacement_count", "SELECT doc_id, CAST(length(text) - length(replace(text, chr(65533), '')) AS BIGINT) AS n FROM documents")
def unicode_replacement_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.unicode_replacement_count(F.col("text")).cast("long").alias("n"))


@query("normalize_dates", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date FROM events")
def normalize_dates(spark, sf):
    kind = F.col("event_id") % 3
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    raw = F.when(kind == 0, sec.cast("string")).when(kind == 1, (sec * 1000).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", T.normalize_date(raw).alias("date"))


@query("parse_study_date", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END AS study_ts FROM events")
def parse_study_date(spark, sf):
    pub = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("")
    return table(spark, sf, "events").select("event_id", T.parse_study_date(pub, F.date_format("ts", "MM-dd-yyyy")).cast("timestamp_ntz").alias("study_ts"))


@query("excerpt", "SELECT doc_id, substr(text, 1, 800) AS excerpt FROM documents")
def excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 800).alias("excerpt"))


@query("descriptor_signature", "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS signature FROM documents")
def descriptor_signature(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.descriptor_signature(F.col("text")).alias("signature"))


@query("normalized_enum", "SELECT o_orderkey, lower(trim(o_orderpriority)) AS priority FROM orders")
def normalized_enum(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.normalized_enum(F.col("o_orderpriority")).alias("priority"))


@query("seeded_hash", "SELECT o_orderkey, sha256(concat('613|', o_orderstatus, '|', CAST(o_orderkey AS VARCHAR))) AS h FROM orders")
def seeded_hash(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.seeded_hash(613, "o_orderstatus", F.col("o_orderkey").cast("string")).alias("h"))


@query("math", "SELECT event_id, round(ln(1 + abs(value)), 6) AS log1p, round(ln(greatest(least(abs(value) / (1 + abs(value)), 0.999999), 0.000001) / (1 - greatest(least(abs(value) / (1 + abs(value)), 0.999999), 0.000001))), 6) AS logit, CAST(sign(value) AS DOUBLE) AS sgn, CAST(ceil(value) AS BIGINT) AS up FROM events")
def math(spark, sf):
    v = F.abs("value")
    p = F.greatest(F.least(v / (1 + v), F.lit(0.999999)), F.lit(0.000001))
    return table(spark, sf, "events").select("event_id", F.round(F.log1p(v), 6).alias("log1p"), F.round(F.log(p / (1 - p)), 6).alias("logit"), F.signum("value").alias("sgn"), F.ceil("value").alias("up"))


@query("vector_ops", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm2 FROM embeddings")
def vector_ops(spark, sf):
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(sq, 4).alias("norm2"))
