import math
import os
import random
import re
from collections import Counter

import pytest

from tessera.llm import toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    before = set(text)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i] or ""), i)
            assert set(ids) == set(first.values())
        before = set(ids)
        docs = docs.where(docs.doc_id.isin(ids))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == before
    assert {(p.doc_id, p.start) for p in corpus_pipeline.run(spark, SF).collect()} == {(p.doc_id, p.start) for p in pieces}


EXTRA = ("toxic", "key", "row", "sha", "again", "component_id", "item_id", "contaminated", "score", "id", "block", "payload")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near(rows):
    """Doc ids that leave: members of a near-copy group other than its smallest, by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = words((t or "").lower())
        if i is not None and w:
            sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    head = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if any(len(a & b) >= 0.8 * len(a | b) for a in sets[i] for b in sets[j]):
                    head[i] = head[j] = min(head[i], head[j])
    return {i for i in head if head[i] != i}


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, repeated rows, copies, a leak, and columns whose names clash."""
    r = random.Random(8)
    say = lambda k: " ".join(f"w{r.randrange(5000)}" for _ in range(k))
    passage = say(40)
    rows = [(i, say(60)) for i in range(24)]
    near_copy = rows[2][1].split()
    near_copy[30] = "changed"
    rows += [(30, rows[1][1]), (31, rows[1][1].replace(" ", "\t ")), (32, " ".join(near_copy)), (33, None), (34, ""), (35, " \n"), (36, say(20_000)), (37, f"{say(50)} {passage} {say(50)}"), rows[5], (None, rows[6][1]), (None, None)]
    at = str(tmp_path_factory.mktemp("sf"))
    tail = (None, "s", *EXTRA)
    spark.createDataFrame([(*x, *tail) for x in rows], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(24)] + [(None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def kept(out, docs):
    assert out.columns == docs.columns
    got = out.collect()
    assert all(tuple(x)[4:] == EXTRA for x in got)
    return Counter((x.doc_id, x.text) for x in got)


def test_copies_stage_against_brute_force(spark, case):
    at, rows = case
    docs = spark.read.parquet(f"{at}/documents.parquet")
    best = {}
    for i, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        best[k] = min(best.get(k, math.inf), math.inf if i is None else i)
    got = kept(corpus_pipeline.drop_copies(spark, docs, at), docs)
    assert sorted(i for i, _ in got) == sorted(best.values()) and set(got.values()) == {1}


def test_near_stage_against_brute_force(spark, case):
    at, rows = case
    docs = spark.read.parquet(f"{at}/documents.parquet")
    gone = near(rows)
    assert {30, 31, 32} <= gone
    assert kept(corpus_pipeline.drop_near_copies(spark, docs, at), docs) == Counter(x for x in rows if x[0] not in gone)


def test_leak_stage(spark, case):
    at, rows = case
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert kept(corpus_pipeline.drop_leaks(spark, docs, at), docs) == Counter(x for x in rows if x[0] != 37)


def test_toxicity_stage_drops_what_scores_high(spark, case):
    at, rows = case
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{at}/labels.parquet"), held_out=toxicity.held_out_by_crc("doc_id", 5, 0))
    high = {t for t, s in docs.select("text", toxicity.scorer(model)("text")).collect() if s >= 0.5}
    assert not high & {None, "", " \n"}
    assert kept(corpus_pipeline.drop_toxic(spark, docs, at), docs) == Counter(x for x in rows if x[1] not in high)


def test_packing_stage_holds_every_row(spark, case):
    at, rows = case
    docs = spark.read.parquet(f"{at}/documents.parquet")
    got = Counter()
    for p in corpus_pipeline.pack(spark, docs, at).collect():
        got[p.doc_id] += p.length
        assert p.offset + p.length <= 2048
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = Counter()
    for i, t in rows:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert got == want


def test_stages_of_an_empty_table(spark, case):
    at, _ = case
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0
