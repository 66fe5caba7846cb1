import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import finishing as Z
from tessera.operators import review as V
from tessera.operators.explain import stability
from tessera.operators.features import candidates, grid, term_counts, tfidf, vocabulary
from tessera.sources import items, sinks


def test_sampler(spark):
    rows = [("x", "a", 0, "g"), ("x", "b", 0, "g"), ("x", "c", 1, "h"), ("y", "a", 0, "g"), ("y", "b", 0, "g"), ("z", "q", 0, None)]
    c = spark.createDataFrame(rows, "stratum string, record_id string, sampling_priority int, balance_group string")
    roster, short = V.sample_roster(c, [("x", 2), ("y", 2), ("w", 1)])
    got = roster.orderBy("selection_order").collect()
    assert len({r.record_id for r in got}) == len(got) and [r.selection_order for r in got] == list(range(1, len(got) + 1))
    assert {r.record_id for r in got if r.stratum == "x"} & {"c"}  # groups take turns
    s = {r.stratum: r for r in short.collect()}
    assert s["w"].status == "unavailable" and s["w"].shortfall == 1
    again, _ = V.sample_roster(c.orderBy(F.rand(1)), [("x", 2), ("y", 2), ("w", 1)])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_two_stages(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "case_id string, a string")
    b = spark.createDataFrame([("1", "u"), ("2", "v")], "case_id string, b string")
    assert V.finalize_two_stage(a, b)[0] == "completed"
    status, issues, got = V.finalize_two_stage(a, b.where("case_id = '1'"))
    assert status == "awaiting_human_validation" and got is None and issues.count() == 1


def test_assigned_probability(spark):
    df = spark.createDataFrame([(0, [0.8, 0.2]), (1, [0.3, 0.7]), (-1, [0.4, 0.3]), (7, [0.1, 0.6])], "t int, p array<double>")
    assert [round(r[0], 6) for r in df.select(V.assigned_probability(F.col("t"), F.col("p"))).collect()] == [0.8, 0.7, 0.6, 0.6]


def test_stability(spark):
    a = spark.createDataFrame([("r", "x", 1.0), ("r", "y", 1.0)], "record_id string, feature string, contribution double")
    b = spark.createDataFrame([("r", "x", -1.0), ("r", "z", 1.0)], "record_id string, feature string, contribution double")
    r = stability(a, b, ["record_id"]).first()
    assert r.jaccard == pytest.approx(1 / 3, abs=1e-6) and r.sign_agreement == 0 and r.cosine < 0


def test_tfidf_and_grid(spark):
    d = spark.createDataFrame([("a", "aa bb aa"), ("b", "bb cc")], "record_id string, text string")
    c = term_counts(d, "text", bigrams=True)
    t = tfidf(c, vocabulary(c), 2)
    assert all(abs(r.s - 1) < 1e-9 for r in t.groupBy("record_id").agg(F.sum(F.col("tfidf") ** 2).alias("s")).collect())
    assert {r.term for r in c.where("record_id = 'a'").collect()} == {"aa", "bb", "aa bb", "bb aa"}
    assert len(grid()) == 8 and len(candidates()) == 49 and candidates()[1]["c"] == 0.1 and candidates()[-1]["c"] == 10.0


def test_csv_items(spark, tmp_path):
    day = tmp_path / "05-01-2020"
    day.mkdir()
    (day / "NewsFakeX.csv").write_text('Unnamed: 0,newstitle,content,abstract,news_url,publish_date\n0,"A, ""title""","line one\nline two",abs,http://x.com/a,2020\n')
    (day / "ClaimRealX.csv").write_text("Unnamed: 0,title,news_url\n0,T,\n")
    (day / "NewsFakeX_tweets.csv").write_text("index,tweet_id\n0,1\n0,1\n0,2\n")
    got = {r.text_unit: r for r in items.read_csv_items(spark, str(tmp_path)).collect()}
    assert got["article"].title == 'A, "title"' and got["article"].body_text == "abs line one line two" and got["article"].harmonized_label == "unreliable"
    assert got["claim"].harmonized_label == "reliable" and got["claim"].collection_date == "05-01-2020"
    t = items.read_csv(spark, str(day / "NewsFakeX_tweets.csv"))
    assert [tuple(r) for r in items.distinct_counts(t, "index", "tweet_id").collect()] == [("0", 2)]
    assert items.distinct_counts(t, "nope", "tweet_id").count() == 0


def test_json_items(spark, tmp_path):
    (tmp_path / "reviews.json").write_text(json.dumps([{"news_id": "n1", "rating": 4, "title": "R1"}, {"news_id": "n2", "rating": 2, "title": "R2"}]))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "n1.json").write_text(json.dumps({"title": "T1", "text": "body", "url": "http://a.b/c"}))
    (tmp_path / "e.json").write_text(json.dumps({"n1": {"tweets": ["1", "1", "2"], "replies": [], "retweets": ["9"]}}))
    got = {r.source_record_id: r for r in items.read_json_items(spark, str(tmp_path / "reviews.json"), str(tmp_path / "c"), str(tmp_path / "e.json")).collect()}
    assert got["n1"].harmonized_label == "reliable" and got["n1"].tweet_count == 2 and got["n1"].native_label == "rating_4" and got["n1"].title == "T1"
    assert got["n2"].parse_status == "content_file_missing" and got["n2"].harmonized_label == "unreliable" and not got["n2"].engagement_available


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "a|b"), (2, 0.5, None)], "i int, x double, s string")
    assert [r.x for r in sinks.strict(df).orderBy("i").collect()] == [None, 0.5]
    md = sinks.markdown_table(df.orderBy("i"))
    assert "| 1 | NA | a\\|b |" in md and "| 2 | 0.500 | NA |" in md
    sinks.write_parquet(df, str(tmp_path / "p"), ["i"])
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert sinks.read_prefer_parquet(spark, str(tmp_path / "no"), str(tmp_path / "c"))[0].count() == 2
    assert sinks.read_prefer_parquet(spark, str(tmp_path / "no"), str(tmp_path / "no2")) == (None, "baseline_artifacts_missing")
    inv = sinks.inventory(spark, str(tmp_path / "c")).collect()
    assert any(r.suffix == ".csv" and len(r.sha256) == 64 for r in inv)


def test_labels(spark):
    df = spark.createDataFrame([("NewsFake.csv", "2.5"), ("NewsReal.csv", "3")], "f string, r string")
    got = [tuple(x) for x in df.select(items.label_from_name(F.col("f")), items.label_from_rating(F.col("r")), items.rating_label(F.col("r"))).collect()]
    assert got == [("unreliable", "unreliable", "rating_2.5"), ("reliable", "reliable", "rating_3")]
    with pytest.raises(Exception, match="no label"):
        df.select(items.label_from_name(F.lit("x"))).collect()


def test_table_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.json").write_text(json.dumps([{"k": 1}, {"j": 2}]))
    (tmp_path / "c.json").write_text("{oops")
    tables, fields = sinks.table_inventory(spark, str(tmp_path))
    got = {r.path[-6:]: (r.records, r.status[:5]) for r in tables.collect()}
    assert got == {"/a.csv": (2, "ok"), "b.json": (2, "ok"), "c.json": (None, "error")}
    assert sorted((r.path[-6:], r.field) for r in fields.collect()) == [("/a.csv", "x"), ("/a.csv", "y"), ("b.json", "j"), ("b.json", "k")]


def _sheets(spark):
    c = spark.createDataFrame([("d", 1, 40, True, "vaccine cure"), ("d", 2, 10, True, "diet"), ("d", 3, 50, True, "x"), ("d", 4, 3, False, "y")], "dataset string, topic_id int, records int, eligible_topic_size boolean, machine_topic_name string")
    said = [(1, "coherent", "none", "n1", "Cures"), (2, "Coherent ", "none", "n1", "Cures"), (3, "mixed", "publisher", None, None)]
    t = spark.createDataFrame(said, "topic_id int, human_topic_coherence string, human_artifact_pattern string, human_narrative_id string, human_narrative_label string")
    t = c.where("eligible_topic_size").join(t, "topic_id").withColumns({"human_topic_stance": F.lit("discussion"), "human_review_confirmation": F.lit("human_reviewed"), "human_label_source": F.lit("reviewer_authored")})
    e = spark.createDataFrame([("d", k, f"r{k}{j}", j, "text") for k in (1, 2, 3) for j in range(2)], "dataset string, topic_id int, record_id string, representative_rank int, excerpt string")
    s = e.withColumns({"human_supports_topic": F.lit("yes"), "human_stance": F.lit("mixed"), "human_artifact_pattern": F.lit("none"), "human_review_confirmation": F.lit("human_reviewed")})
    return c, t, s, e


def test_narrative_gates(spark):
    c, t, s, e = _sheets(spark)

    def run(t=t, s=s, **kw):
        return Z.finalize_narratives(c, t, s, e, least_representatives=2, **kw)

    status, _, narratives, mapping, outcomes = run()
    assert status == "completed"
    n = narratives.first()
    assert narratives.count() == 1 and (n.records, n.topics, n.representatives_supporting, n.retained) == (50, "1|2", 4, True)
    assert {r.topic_id for r in mapping.collect()} == {1, 2}
    assert {r.topic_id: r.retention_reason for r in outcomes.collect()} == {1: "retained_after_human_validation", 2: "retained_after_human_validation", 3: "rejected_publisher_artifact_pattern"}
    assert run(least_documents=51)[2].first().retention_reason == "fewer_than_minimum_documents"
    one = lambda col, v: t.withColumn(col, F.when(F.col("topic_id") == 1, v).otherwise(F.col(col)))
    for sheet, gate in (
        (one("human_review_confirmation", None), "confirmation"),
        (one("human_narrative_label", "Vaccine, CURE!"), "machine label"),
        (one("human_narrative_label", "Other"), "merged labels"),
        (one("human_label_source", "machine"), "label source"),
        (one("records", 41), "topic review: context"),
        (t.where("topic_id <> 1"), "topic review: missing row"),
        (t.unionByName(t), "repeated in topic review"),
        (t.withColumn("topic_id", F.lit("1.5")), "key"),
    ):
        status, issues, narratives, _, _ = run(t=sheet)
        assert status == "awaiting_human_validation" and narratives is None and gate in {r.gate for r in issues.collect()}, gate
    assert "representatives" in {r.gate for r in run(s=s.withColumn("human_stance", F.lit("")))[1].collect()}
    assert run(s=s.drop("record_id"))[1].first().gate == "schema"
    with pytest.raises(ValueError):
        run(confirmation=" ")


def test_audit_gates(spark):
    base = spark.createDataFrame([("c1",), ("c2",)], "case_id string").withColumns({"audit_protocol_version": F.lit(Z.AUDIT_VERSION), "audit_roster_sha256": F.lit("h")})
    revealed = {c: F.lit("v") for c in Z.AUDIT_REVEALED}
    a_codes = {**{c: F.lit("Yes") for c in Z.AUDIT_SIGNALS}, "stage_a_stance": F.lit("mixed"), "stage_a_notes": F.lit(" n ")}
    b_codes = {"stage_b_error_code": F.lit("topic_shortcut"), "stage_b_review_notes": F.lit("m")}
    a, b = base.withColumns(a_codes), base.withColumns(revealed | b_codes)
    template = base.withColumns(revealed | {c: F.lit("") for c in [*a_codes, *b_codes]})
    status, _, cases, summary = Z.finalize_audit(a, b, template)
    assert status == "completed" and cases.count() == 2 and cases.first().stage_a_notes == "n"
    assert {(r.field, r.value, r.n) for r in summary.collect()} >= {("stage_b_error_code", "topic_shortcut", 2), ("stage_a_stance", "mixed", 2)}
    for x, y, gate in (
        (a.withColumn("stage_a_stance", F.lit("odd")), b, "vocabulary"),
        (a, b.withColumn("stage_b_review_notes", F.lit(None).cast("string")), "blank"),
        (a.withColumn("audit_roster_sha256", F.lit("other")), b, "stages differ"),
        (a.withColumn("audit_protocol_version", F.lit("v0")), b, "protocol version"),
        (a, b.withColumn("anchor_outcome", F.lit("changed")), "stage B: context"),
        (a.where("case_id = 'c1'"), b, "stage A: missing row"),
        (a.limit(0), b, "no cases"),
        (a.drop("stage_a_notes"), b, "schema"),
    ):
        status, issues, got, _ = Z.finalize_audit(x, y, template)
        assert status == "awaiting_human_validation" and got is None and gate in {r.gate for r in issues.collect()}, gate


def test_headers_in_one_job_and_table_inventory(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "one.csv").write_text('x,y\n1,"two\nlines"\n2,z\n')
    (tmp_path / "two.csv").write_text("x,y\n5,6\n")
    (tmp_path / "three.csv").write_text('"x\nx",y\n7,8\n')
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("x,z\n")
    (tmp_path / "list.json").write_text('[{"k": 1}, {"m": 2}]')
    (tmp_path / "bad.json").write_text("{")
    groups = items.by_header(spark, [str(p) for p in tmp_path.rglob("*.csv")])
    assert sorted(sorted(p.rsplit("/", 1)[1] for p in g) for g in groups) == [["head.csv"], ["one.csv", "two.csv"], ["three.csv"]]
    assert items.read_csv_files(spark, [str(tmp_path / "a b" / "one.csv"), str(tmp_path / "head.csv")]).count() == 2
    tables, fields = sinks.table_inventory(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.records, r.status[:5]) for r in tables.collect()}
    assert got == {"one.csv": ("csv", 2, "ok"), "two.csv": ("csv", 1, "ok"), "three.csv": ("csv", 1, "ok"), "head.csv": ("csv", 0, "ok"), "list.json": ("json", 2, "ok"), "bad.json": ("json", None, "error")}
    assert sorted(r.field for r in fields.where("path like '%list.json' or path like '%head.csv'").collect()) == ["k", "m", "x", "z"]
