"""Term counts made where the rows are, sums of large arrays, and titles as their SQL reads them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import features as V
from tessera.operators import linear as L
from tessera.operators import sums
from tessera.plans.adapters import ampersand_titles

TEXTS = ["The cat, the DOG", "", None, "one", "été été the cat " * 40, "a b", "dog the cat the dog"]


def plain(texts, bigrams):
    out = {}
    for i, t in enumerate(texts):
        words = [w.strip(",").lower() for w in (t or "").split() if len(w.strip(",")) > 1]
        for x in words + ([f"{a} {b}" for a, b in zip(words, words[1:])] if bigrams else []):
            out[i, x] = out.get((i, x), 0) + 1
    return out


@pytest.mark.parametrize("bigrams", [False, True])
def test_counts_of_portions(spark, monkeypatch, bigrams):
    monkeypatch.setattr(V, "PORTION", 20)
    words = pa.array([" ".join(w.strip(",").lower() for w in (t or "").split() if len(w.strip(",")) > 1) for t in TEXTS])
    batch, got, at = pa.RecordBatch.from_arrays([words], ["words"]), {}, 0
    for p in V.portions([batch], "words"):
        c = V.Counts(p.column("words"), bigrams)
        names = c.names.to_pylist()
        got |= {(at + int(r), names[t]): int(n) for r, t, n in zip(c.row, c.term, c.tf)}
        at += p.num_rows
    assert at == len(TEXTS) and got == plain(TEXTS, bigrams)


@pytest.mark.parametrize("bigrams", [False, True])
def test_term_counts_need_no_exchange(spark, bigrams):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "record_id long, text string").repartition(3)
    got = V.term_counts(docs, "text", bigrams)
    assert {(r["record_id"], r["term"]): r["tf"] for r in got.collect()} == plain(TEXTS, bigrams)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    twice = V.term_counts(docs.unionByName(docs), "text", bigrams)
    assert {(r["record_id"], r["term"]): r["tf"] for r in twice.collect()} == {k: 2 * n for k, n in plain(TEXTS, bigrams).items()}


def test_driver_gets_one_large_array(spark, monkeypatch):
    monkeypatch.setattr(sums, "SLICE", 1 << 10)
    df = spark.range(0, 4000, 1, 40)
    rows = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: rows.append(collect(self)) or rows[-1])
    got = sums.summed(df, lambda bs: np.outer(np.arange(10.0), np.full(500, float(sum(b.num_rows for b in bs)))), (10, 500))
    assert np.array_equal(got, np.outer(np.arange(10.0), np.full(500, 4000.0)))
    assert sum(len(r["total"]) for r in rows[-1]) == 10 * 500 * 8


def test_steps_hold_active_coordinates_only():
    seen = []

    def evaluate(live, points):
        seen.append(points.copy())
        return ((points - 1) ** 2).sum(1) / 2, points - 1

    x, _, _ = L.solve(evaluate, 2, 6, gap=1e-12, active=[np.array([0, 2, 5]), np.arange(6)])
    assert np.allclose(x, [[1, 0, 1, 0, 0, 1], [1] * 6], atol=1e-5)
    assert all((p[0, [1, 3, 4]] == 0).all() for p in seen if len(p) == 2)


def test_titles_decode_the_ampersand_alone(spark, tmp_path):
    titles = ["a &amp; b &quot;c&quot;", "cut &amp", "&amp;lt; x", "plain"]
    spark.createDataFrame([(i, "u", f"<title>{t}</title>") for i, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = ampersand_titles(spark, str(tmp_path)).select("page_id", T.clean_text("title").alias("t")).orderBy("page_id")
    assert [r["t"] for r in got.collect()] == ["a & b &quot;c&quot;", "cut &amp", "&lt; x", "plain"]
    assert spark.range(1).select(T.clean_text(F.lit("&quot;c&quot;")).alias("t")).first()["t"] == '"c"'


def test_weights_of_a_batch_are_those_of_each_document():
    from tessera.operators.topics import Weighted

    r = np.random.default_rng(3)
    h, sets = r.random((4, 9)), [[0, 3, 8], [], [2], [1, 2, 5, 7]]
    xs = [r.random(len(s)).tolist() for s in sets]
    got = Weighted(pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float64()))], ["i", "x"]), h)
    sums = np.zeros((4, 13))
    for k, (i, x) in enumerate(zip(sets, xs)):
        w = np.full(4, sum(x) / h.sum())
        for _ in range(30):
            w *= (h[:, i] @ np.array(x) if i else np.zeros(4)) / (h @ h.T @ w + 1e-12)
        assert np.allclose(got.w[k], w)
        if i:
            sums[:, i] += np.outer(w, x)
        sums[:, 9:] += np.outer(w, w)
    assert np.allclose(got.sums(9), sums)


def test_totals_and_vectors_are_those_of_the_counts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "record_id long, text string").repartition(2)
    want = {(r["term"], r["df"], r["total"]) for r in V.vocabulary(V.term_counts(docs, "text", True)).collect()}
    assert {tuple(r) for r in V.term_totals(docs, "text", True).select("term", "df", "total").collect()} == want
    vocab = V.vocabulary(V.term_counts(docs, "text"), 2)
    known = vocab.orderBy("term").collect()
    idf = np.log((1 + len(TEXTS)) / (1 + np.array([r["df"] for r in known]))) + 1
    names = [r["term"] for r in known]
    got = {(r["record_id"], names[i]): x for r in V.vectors(docs, "text", names, idf).collect() for i, x in zip(r["i"], r["x"])}
    plain_values = {(r["record_id"], r["term"]): r["tfidf"] for r in V.tfidf(V.term_counts(docs, "text"), vocab, len(TEXTS)).collect()}
    assert got.keys() == plain_values.keys() and all(abs(got[k] - plain_values[k]) < 1e-12 for k in got)


def test_pages_keep_address_body_and_entities(spark, tmp_path):
    """Keys and ids of a page come from its address, title and text outside the markup, as in the SQL."""
    import duckdb

    from tessera.plans import linkage, scalar  # noqa: F401
    from tessera.plans.registry import oracle_sql, queries

    long = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, "https://www.Example.com//a/b/?utm_source=x&b=2", f"<title>Six words &quot;in&quot; a long title &amp</title><script>no</script><p>{long} &middot; end</p>"),
        (2, "https://example.com/a/b?b=2", f"<title>short</title><!-- no --><p>{long}</p>"),
        (3, None, "<title>null</title><p>few words"),
        (4, "https://example.com/", "<title>A title of quite enough words here</title>"),
        (5, None, None),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("family_exact_keys", "family_group_id"):
        got = sorted(tuple(r) for r in queries()[name](spark, str(tmp_path)).collect())
        assert got == sorted(c.execute(oracle_sql()[name]).fetchall()), name
        if name == "family_exact_keys":
            assert [k for r, k in got if k.startswith("url:")] == ["url:https://example.com/a/b?b=2"] * 2
            assert [r for r, k in got if k.startswith("body:")] == ["1", "2"]
        else:
            assert got[0][1] == got[1][1]


def test_tfidf_has_pairs_and_no_accents(spark, tmp_path):
    import duckdb

    from tessera.plans import modelling  # noqa: F401
    from tessera.plans.registry import oracle_sql, queries

    rows = [(1, "Café déjà vu"), (2, "cafe deja-vu vu"), (3, None), (4, ""), (5, "été")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries()["tfidf"](spark, str(tmp_path)).collect())
    assert got == sorted(c.execute(oracle_sql()["tfidf"]).fetchall())
    assert {t for _, t, _ in got} == {"cafe", "deja", "vu", "cafe deja", "deja vu"}
