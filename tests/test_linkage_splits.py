import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import linkage as L
from tessera.operators import splits as P
from tessera.operators.graph import connected_components
from tessera.operators.relational import ContractError, join_checked, require_columns, same_keys, same_rows

ITEM = "dataset string, record_id string, url string, alternate_urls string, title string, body_text string, model_text string"


def test_three_records_one_family(spark):
    body = " ".join(f"word{i}" for i in range(35))
    df = spark.createDataFrame(
        [("d", "a", "", "[]", "A long enough title about six words", body, "x a"), ("d", "b", "", "[]", "A long enough title about six words", "other", "x b"), ("d", "c", "http://e.com/p", "[]", "Short", body, "x c"), ("d", "e", "", '["http://www.e.com/p?utm_x=1"]', "None", "", ""), ("e", "a", "", "[]", "A long enough title about six words", body, "x a")],
        ITEM,
    )
    fam = L.families(df, L.key_edges(L.exact_keys(df))).collect()
    size = {(r.dataset, r.record_id): r.family_size for r in fam}
    assert size == {("d", "a"): 4, ("d", "b"): 4, ("d", "c"): 4, ("d", "e"): 4, ("e", "a"): 1}
    assert len({r.family_group for r in fam}) == 2


def test_fuzzy_titles(spark):
    base = "remarkable discovery changes the understanding of sleeping patterns worldwide"
    others = ["market prices fall sharply after the surprise election result tonight", "local football club wins championship for third year running again", "new railway line opens between coastal towns despite long delays"]
    rows = [("d", "a", "", "[]", base, "", ""), ("d", "b", "", "[]", base + "s", "", ""), ("d", "c", "", "[]", base.upper() + "!", "", "")] + [("d", f"o{i}", "", "[]", t, "", "") for i, t in enumerate(others)]
    e = L.fuzzy_title_edges(spark.createDataFrame(rows, ITEM), threshold=0.95)
    got = {tuple(sorted((r.src, r.dst))) for r in e.collect()}
    assert ("a", "b") in got and ("a", "c") in got and not any("o" in x for p in got for x in p)


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(1000 + i, 1000) for i in range(1, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain + hub + [(5000, 5000), (None, 3)], "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[1000 + i] == 1000 for i in range(300)) and got[5000] == 5000
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_quality_rules(spark):
    rows = [("d", "1", "g", "reliable", ""), ("d", "2", "g", "unreliable", ""), ("d", "3", "h", "reliable", ""), ("d", "4", "h", "reliable", ""), ("d", "5", "h", "unreliable", "near_empty_text"), ("d", "6", "k", None, "")]
    got = {r.record_id: r.exclusion_reason for r in L.apply_quality_rules(spark.createDataFrame(rows, "dataset string, record_id string, duplicate_group string, harmonized_label string, exclusion_reason string")).collect()}
    assert got == {"1": "conflicting_exact_duplicate", "2": "conflicting_exact_duplicate", "3": "", "4": "exact_duplicate", "5": "near_empty_text", "6": ""}


def roster(spark, n=600):
    return spark.range(n).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("record_id"), F.lit("d").alias("dataset"), F.when(F.col("id") % 3 == 0, "unreliable").otherwise("reliable").alias("harmonized_label"), F.when(F.col("id") % 2 == 0, "article").otherwise("claim").alias("text_unit"), (F.col("id") % 60).cast("string").alias("grp"))


def test_splits(spark):
    r = roster(spark)
    s = r.join(P.standard_split(r, "grp"), "grp")
    assert P.split_issues(s, "grp") == []
    share = {x.split: x["count"] / 600 for x in s.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.6) < 0.05
    best = P.group_disjoint_split(r, "grp", 30)
    assert P.split_integrity(best, ["grp"]).first().crossing == 0
    scores = {x.attempt: x.score for x in P.group_disjoint_attempts(r, "grp", 30).collect()}
    assert len(scores) == 30
    assert P.split_score(best, P.SplitSettings()).first().score == pytest.approx(min(scores.values()))
    assert any("crosses" in x for x in P.split_issues(s.withColumn("grp", F.lit("one")), "grp"))


def test_settings():
    with pytest.raises(ContractError, match="unknown"):
        P.SplitSettings.of({"nope": 1})
    with pytest.raises(ContractError, match="add up"):
        P.SplitSettings(train_fraction=0.9)
    with pytest.raises(ContractError):
        P.SplitSettings(maximum_group_fraction=1.5)


def test_temporal_split_leaves_straddlers_out(spark):
    df = spark.createDataFrame([("f1", "2020-01-01"), ("f1", "2020-02-01"), ("f2", "2020-01-15"), ("f2", "2020-09-01"), ("f3", "2020-05-01"), ("f4", "2020-12-01")], "fam string, d string").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    got = {r.fam: r.split for r in P.temporal_split(df, "ts", "fam", "2020-03-01", "2020-06-01").collect()}
    assert got == {"f1": "train", "f3": "validation", "f4": "test"}


def test_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, v string")
    with pytest.raises(ContractError):
        join_checked(a, b, ["k"], validate="1:1")
    assert join_checked(a, b, ["k"], validate="m:1", suffixes=("_a", "_b")).columns == ["k", "v_a", "v_b"]
    with pytest.raises(ContractError, match="lacks"):
        require_columns(a, {"nope"}, "a")
    assert same_keys(a, b, ["k"]) and same_rows(a, a.orderBy(F.desc("v"))) and not same_rows(a, b)


def test_split_precedence(spark):
    r = roster(spark, 1200).withColumnsRenamed({"grp": "publisher_id"})
    m, why = P.split_precedence(r, P.SplitSettings(publisher_attempts=20))
    assert why[0][:2] == ("publisher_disjoint", "available") and P.split_issues(m, "publisher_id", True) == []
    one = r.withColumn("publisher_id", F.lit("")).withColumn("family_group", F.col("record_id")).withColumn("study_ts", (F.lit("2020-01-01").cast("timestamp_ntz") + F.expr("make_interval(0,0,0,cast(substr(record_id, 2) as int) % 200)")))
    m, why = P.split_precedence(one, P.SplitSettings())
    assert [w[1] for w in why] == ["unavailable", "unavailable", "available"] and m.where("split IS NULL").count() == 0


def test_config(spark, tmp_path):
    from tessera import config

    (tmp_path / "s.json").write_text('{"run_id": "x"}')
    (tmp_path / "l.json").write_text("[1]")
    assert config.load_json(spark, str(tmp_path / "s.json")) == {"run_id": "x"}
    with pytest.raises(ContractError):
        config.load_json(spark, str(tmp_path / "l.json"))
    assert not config.folders_exist(spark, str(tmp_path))


# ---- near titles against a plain nearest-neighbour search --------------------


def plain_grams(title):
    out = []
    for w in title.split():
        w = f" {w} "
        out += [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return out


def plain_title_edges(rows, threshold, neighbours=7, ratio=0.85):
    """By record: a record's nearest others by (similarity, equal titles first, least record of the title)."""
    out = set()
    for d in {r[0] for r in rows}:
        own = {i: t for dd, i, t in rows if dd == d and len(t) >= 30 and len(t.split()) >= 6}
        name = {t: min(i for i in own if own[i] == t) for t in own.values()}
        grams = {t: Counter(plain_grams(t)) for t in name}
        df = Counter(g for t in own.values() for g in grams[t])
        vec = {}
        for t in name:
            x = {g: n * (math.log((1 + len(own)) / (1 + df[g])) + 1) for g, n in grams[t].items() if df[g] >= 2}
            norm = math.sqrt(sum(v * v for v in x.values()))
            vec[t] = {g: v / norm for g, v in x.items()} if norm else {}
        for t, i in name.items():
            near = []
            for j, u in own.items():
                if j != i:
                    sim = 1.0 if u == t else round(sum(v * vec[u].get(g, 0) for g, v in vec[t].items()), 12)
                    near.append((u != t, -sim, name[u], j, u, sim))
            for other, _, _, _, u, sim in sorted(near)[:neighbours]:
                if other and sim >= threshold and min(len(t), len(u)) >= ratio * max(len(t), len(u)):
                    out.add((d, *sorted((name[t], name[u]))))
        out |= {(d, name[t], i) for i, t in own.items() if i != name[t]}
    return out


def star_titles():
    r = random.Random(4)
    words = ["remarkable", "discovery", "changes", "the", "understanding", "of", "sleeping", "patterns", "worldwide", "today", "a", "in"]
    long = lambda k: " ".join(r.choice(words) for _ in range(k))
    base = long(24)
    rows = [("d", "a00", base)]
    for i in range(1, 27):  # a star: each differs from the base in one word
        w = base.split()
        w[i % 24] = "".join(r.choice("bcdfgjklmpqvwxz") for _ in range(9))
        rows.append(("d", f"a{i:02d}", " ".join(w)))
    rows += [("d", "b1", base), ("d", "b2", base + " x y"), ("d", "b3", (base + " ") * 2 + base), ("e", "a00", base), ("e", "a01", base + " z"), ("d", "s", "too short")]
    rows += [("d", f"c{i}", long(18)) for i in range(20)]
    same = long(20)
    return rows + [("d", f"m{i}", same) for i in range(9)] + [("d", "n1", same + " a"), ("d", "n2", same + " in a")]


@pytest.mark.parametrize(("threshold", "block"), [(0.97, 2000), (0.8, 3)])
def test_fuzzy_edges_match_plain_neighbours(spark, threshold, block):
    rows = star_titles()
    df = spark.createDataFrame([(d, i, "", "[]", t, "", "") for d, i, t in rows], ITEM).repartition(3)
    got = L.fuzzy_title_edges(df, threshold=threshold, block=block).collect()
    want = plain_title_edges(rows, threshold)
    assert {(r.dataset, r.src, r.dst) for r in got} == want and len(got) == len(want)
    if threshold == 0.8:
        assert sum("a00" in e for e in want) > 7  # more than its own seven: the others keep it among theirs


def test_fuzzy_edges_of_nothing(spark):
    assert L.fuzzy_title_edges(spark.createDataFrame([], ITEM)).collect() == []


# ---- dealing groups ---------------------------------------------------------


def one_by_one(classes, targets, total):
    have, out = [[0] * len(total) for _ in targets], []
    for v, m in classes:
        given = [0] * len(targets)
        for _ in range(m):
            cost = [round(sum(abs(h + a - t * n) - abs(h - t * n) for h, a, n in zip(have[k], v, total)), 6) for k, t in enumerate(targets)]
            k = cost.index(min(cost))
            have[k] = [h + a for h, a in zip(have[k], v)]
            given[k] += 1
        out.append(given)
    return out


def test_classes_are_dealt_as_groups_one_by_one():
    r = random.Random(1)
    for _ in range(60):
        strata = r.randint(1, 4)
        classes = sorted({tuple(r.randint(0, 6) for _ in range(strata)) for _ in range(r.randint(1, 12))} - {(0,) * strata}, key=lambda v: (-sum(v), v))
        classes = [(v, r.choice([1, 2, 7, 150])) for v in classes] or [((1,) * strata, 40)]
        total = [sum(m * v[i] for v, m in classes) for i in range(strata)]
        assert P.deal(classes, (0.6, 0.2, 0.2), total) == one_by_one(classes, (0.6, 0.2, 0.2), total)
    assert P.deal([((1,), 30_000_000)], (0.6, 0.2, 0.2), [30_000_000]) == [[18_000_000, 6_000_000, 6_000_000]]


def test_standard_split_of_single_records(spark, monkeypatch):
    from tessera.operators import prefix

    monkeypatch.setattr(prefix, "RANGE_ROWS", 70)
    r = roster(spark, 900).withColumn("grp", F.col("record_id"))
    s = r.join(P.standard_split(r, "grp"), "grp")
    assert s.count() == 900 and P.split_score(s, P.SplitSettings()).first().score < 0.02
    assert {x.split: x["count"] for x in s.groupBy("split").count().collect()} == {"train": 540, "validation": 180, "test": 180}


def test_repeats_in_one_job(spark):
    r = roster(spark)
    best = P.best_attempts(r, "grp", 20, repeats=3)
    assert [b // 20 for b in best] == [0, 1, 2]
    m, again = P.repeat_memberships(r, "grp", 3, 20)
    assert again == best
    for k, b in enumerate(best):
        own = {x.record_id: x.split for x in r.withColumn("split", P.attempt_split("grp", b)).collect()}
        bits = {x.record_id: ["train", "validation", "test"][[x.member >> (3 * j + k) & 1 for j in range(3)].index(1)] for x in m.collect()}
        assert bits == own
    with pytest.raises(ContractError):
        P.repeat_memberships(r, "grp", 30, 5)


def test_near_titles_meet_by_exchanges(spark):
    """The driver builds no broadcast of a part of the titles: what meets on an n-gram is merged."""
    df = spark.createDataFrame([("d", f"r{i}", f"one telling title about the same matter number {i % 3}") for i in range(9)], "dataset string, record_id string, title string")
    pairs = L.similar_pairs(L.title_vectors(df.select("dataset", F.col("record_id").alias("id"), F.lit(1).alias("times"), "title")), 0.97)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan.split("Join")[1] and plan.count("strategy=merge") >= 3
