"""Queries over whole tables, one for each operator, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, lang_id, packing, toxicity
from tessera.llm.embedding_dedup import near_vectors
from tessera.llm.exact_dedup import dedup_exact
from tessera.llm.secret_scan import BASE, MORE, secrets_by_document
from tessera.llm.simhash import simhash_groups
from tessera.llm.substring_dedup import dedup_windows
from tessera.llm.suffix_dedup import dedup_suffixes
from tessera.llm.token_align import align
from tessera.llm.url_filter import SOFT, STRICT, filter_urls
from tessera.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return dedup_suffixes(docs, min_len=50, with_text=False).drop("kept_text")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.find_contaminated(docs, _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(docs, labels, held_out=toxicity.held_out_by_crc("doc_id", 5, 0))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.held_out_by_crc("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages", "page_id", "url")).drop("weight")


def op5_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = lang_id.train(docs, held_out=held_out)
    got = lang_id.predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents", "doc_id", "text"), words=3)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), room=2048, end_id=1)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_by_document(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return dedup_windows(docs, window=35, with_text=False).drop("kept_text")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), threshold=0.93)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), components=8)


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_decontaminate, op3_toxicity, op4_url_filter, op5_lang_id, op6_simhash, op7_packing,
        op8_exact_dedup, op9_secret_scan, op10_substring_dedup, op11_embedding_dedup, op12_whitening, op13_token_align,
    )
}


def _hit(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"


_OP4 = f"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages),
    r AS (SELECT page_id, lower(url) AS u, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM p),
    h AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    d AS (SELECT *, concat('.', host) AS dot,
                 CASE WHEN {" OR ".join(map(_hit, STRICT))}
                        OR {" + ".join(f"CASE WHEN {_hit(t)} THEN 1 ELSE 0 END" for t in SOFT)} >= 2 THEN 'block' ELSE 'allow' END AS own FROM h),
    x AS (SELECT *, CASE WHEN suffix(dot, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                         WHEN suffix(dot, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                         WHEN suffix(dot, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
                         WHEN suffix(dot, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
                         WHEN suffix(dot, '.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM d)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IS NULL THEN own WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' ELSE 'block' END AS verdict FROM x"""


def _op9() -> str:
    """Contract patterns for the base kinds (least length in the predicate), the method's own rules as they are."""
    base = (("assign", BASE[0].pattern, 2, "length(g) >= 12"), ("access", "AKIA[A-Z0-9]+", 0, "length(w) >= 18"), ("hex", "[0-9a-f]+", 0, "length(w) >= 16"))
    base = tuple((k, p.replace("(?i:password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"), g, ok) for k, p, g, ok in base)
    every = base + tuple((r.kind, r.pattern, 0, "true") for r in MORE)
    found = []
    for i, (kind, pattern, group, ok) in enumerate(every):
        quoted = pattern.replace("'", "''")
        found.append(f"""SELECT doc_id, {i} AS o, '{kind}' AS kind, till - length(w) AS s, till AS e
            FROM (SELECT doc_id, w, g, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY j) AS till
                  FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{quoted}')) AS w, unnest(regexp_extract_all(t, '{quoted}', {group})) AS g,
                               unnest(string_split_regex(t, '{quoted}')) AS gap, unnest(generate_series(1, len(string_split_regex(t, '{quoted}')))) AS j
                        FROM d WHERE regexp_matches(t, '{quoted}')) WHERE w IS NOT NULL) WHERE {ok}""")
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(found)}),
        x AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
                     string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, o) FILTER (WHERE o < {len(base)}) AS base, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, o) AS spans FROM f GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN x ON d.doc_id = x.doc_id"""


ORACLE: dict[str, str] = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
        hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id),
        new AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM hit),
        run AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM new) GROUP BY doc_id, r),
        gap AS (SELECT run.doc_id, s, e, substr(h, 2 * lag(e, 1, 0) OVER (PARTITION BY run.doc_id ORDER BY s) + 1, 2 * (s - lag(e, 1, 0) OVER (PARTITION BY run.doc_id ORDER BY s))) AS piece FROM run JOIN d ON d.doc_id = run.doc_id),
        kept AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS stop, string_agg(piece, '' ORDER BY s) AS head FROM gap GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(concat(coalesce(head, ''), substr(h, 2 * coalesce(stop, 0) + 1)))) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op9_secret_scan": _op9(),
    "op4_url_filter": _OP4,
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op11_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        fit AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
                WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: isfinite(x))) = len(e)),
        link AS (SELECT a.vec_id AS s, b.vec_id AS d FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                 WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
        reach AS (SELECT vec_id AS s, vec_id AS d FROM v UNION SELECT reach.s, link.d FROM reach JOIN link ON reach.d = link.s),
        least AS (SELECT s, min(d) AS component_id FROM reach GROUP BY s), n AS (SELECT s, count(*) AS n_links FROM link GROUP BY s)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN least ON least.s = vec_id LEFT JOIN n ON n.s = vec_id""",
    "op10_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS k
                FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM rep)),
        word AS (SELECT doc_id, unnest(ws) AS x, unnest(generate_series(1, len(ws))) AS p FROM w WHERE len(ws) > 0),
        kept AS (SELECT word.doc_id, count(*) AS n_words, count(gone.p) AS n_removed,
                        coalesce(string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL), '') AS t
                 FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
        SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
}
