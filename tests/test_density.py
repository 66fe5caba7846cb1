"""Neighbour graphs and density clusters against plain searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import density
from tessera.operators.density import density_clusters, reachability
from tessera.operators.models import cluster_topics, principal
from tessera.operators.neighbours import graph_recall, neighbour_graph
from tessera.runtime import Workspace


def planted(seed=3):
    """Three groups of unlike density, one of them in two, and stray points."""
    r = np.random.default_rng(seed)
    parts = [r.normal(0, 0.3, (60, 4)) + [5, 0, 0, 0], r.normal(0, 0.1, (40, 4)) + [0, 5, 0, 0], r.normal(0, 0.1, (45, 4)) + [0, 6, 0, 0], r.normal(0, 1.0, (70, 4)) + [0, 0, 9, 0], r.uniform(-12, 12, (25, 4))]
    x = np.concatenate([*parts, parts[0][:3]])
    return x, np.concatenate([np.full(len(p), i) for i, p in enumerate(parts)] + [np.zeros(3, int)])


def frame(spark, x):
    return spark.createDataFrame([(i * 7 + 1, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(3)


def plain_clusters(links, ids, min_size):
    """Top down: heaviest links of the spanning tree go one by one."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    tree = []
    for w, a, b in sorted(links):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            tree.append((w, a, b))

    def split(nodes, edges):
        side = {n: n for n in nodes}

        def top(x):
            while side[x] != x:
                side[x] = side[side[x]]
                x = side[x]
            return x

        for _, a, b in edges:
            side[top(a)] = top(b)
        out = {}
        for n in nodes:
            out.setdefault(top(n), set()).add(n)
        return list(out.values())

    clusters = []  # birth, leaving (node, density), children

    def grow(nodes, edges, birth):
        me = dict(birth=birth, left=[], children=[], size=len(nodes))
        edges = sorted(edges)
        while edges:
            w, a, b = edges.pop()
            one, two = split(nodes, edges)
            large = [s for s in (one, two) if len(s) >= min_size]
            if len(large) == 2:
                me["split"] = 1 / w
                me["children"] = [grow(s, [e for e in edges if e[1] in s], 1 / w) for s in large]
                break
            if not large:
                me["left"] += [(n, 1 / w) for n in nodes]
                break
            me["left"] += [(n, 1 / w) for n in nodes - large[0]]
            nodes, edges = large[0], [e for e in edges if e[1] in large[0]]
        clusters.append(me)
        return me

    tops = [s for s in split(set(ids), tree) if len(s) >= min_size]
    if len(tops) == 1:
        whole = grow(tops[0], [e for e in tree if e[1] in tops[0]], 0.0)
    else:
        whole = dict(birth=0.0, left=[], children=[grow(s, [e for e in tree if e[1] in s], 0.0) for s in tops], size=sum(map(len, tops)), split=0.0)

    def choose(c, is_root):
        below = [choose(x, False) for x in c["children"]]
        stable = sum(d - c["birth"] for _, d in c["left"]) + sum(x["size"] * (c["split"] - c["birth"]) for x in c["children"])
        if not is_root and (not below or stable >= sum(s for s, _ in below)):
            return stable, [c]
        return sum(s for s, _ in below), [k for _, ks in below for k in ks]

    def points(c):
        return c["left"] + [p for x in c["children"] for p in points(x)]

    out = {i: (-1, 0.0) for i in ids}
    kept = choose(whole, True)[1]
    named = sorted(kept, key=lambda c: (-len(points(c)), min(n for n, _ in points(c))))
    for k, c in enumerate(named):
        top = max([d for _, d in c["left"]] + ([c["split"]] if c["children"] else []))
        for n, d in points(c):
            out[n] = (k, min(d, top) / top)
    return out


@pytest.mark.parametrize(("few", "min_size", "k"), [(100_000, 12, 400), (0, 6, 12)])
def test_clusters_match_a_plain_hierarchy(spark, few, min_size, k):
    x, _ = planted()
    df = frame(spark, x)
    graph = neighbour_graph(df, k, trees=2, refine=0)
    links = [(r.w, r.a, r.b) for r in reachability(graph, min(min_size, k)).collect()]
    want = plain_clusters(links, [i * 7 + 1 for i in range(len(x))], min_size)
    got = {r.id: (r.cluster, r.probability) for r in density_clusters(df, min_size=min_size, min_samples=min(min_size, k), k=k, few=few, trees=2, refine=0).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], rel=1e-6) for i in got)


def test_planted_densities_are_found(spark):
    x, truth = planted()
    got = {r.id: r.cluster for r in density_clusters(frame(spark, x), min_size=12).collect()}
    label = np.array([got[i * 7 + 1] for i in range(len(x))])
    found = set()
    for t in range(4):
        c, n = np.unique(label[truth == t], return_counts=True)
        assert n.max() >= 0.85 * (truth == t).sum() and c[n.argmax()] >= 0
        found.add(int(c[n.argmax()]))
    assert len(found) == 4 and (label[truth == 4] == -1).mean() > 0.6


def test_graph_recall_of_many_vectors(spark):
    r = np.random.default_rng(8)
    centres = r.standard_normal((12, 24))
    x = centres[r.integers(0, 12, 1500)] + 0.5 * r.standard_normal((1500, 24))
    df = frame(spark, x).withColumn("id", F.col("id") - 1).cache()
    plain = neighbour_graph(df, 10, trees=4, block=250, refine=0)
    better = neighbour_graph(df, 10, trees=4, block=250, refine=1)
    a, b = (graph_recall(df, g, 10) for g in (plain, better))
    assert b >= 0.9 and b >= a > 0.5
    df.unpersist()


def test_nothing_copies_and_one_cluster(spark):
    schema = "id long, v array<double>"
    assert density_clusters(spark.createDataFrame([], schema)).collect() == []
    same = density_clusters(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], schema), min_size=5).collect()
    assert {r.cluster for r in same} == {-1}  # a single cluster is the root, which is never kept
    two = density_clusters(spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(40)], schema), min_size=5, k=8, few=0).collect()
    assert {(r.id % 2, r.cluster, r.probability) for r in two} == {(0, 0, 1.0), (1, 1, 1.0)}


def test_hubs_take_few_rounds_and_the_driver_gets_a_forest(spark, monkeypatch):
    x, _ = planted()
    df = frame(spark, x)
    made, taken = [], []
    keep, merge = Workspace.keep, density.merge_all
    monkeypatch.setattr(Workspace, "keep", lambda ws, d, name="t": made.append(name) or keep(ws, d, name))
    monkeypatch.setattr(density, "merge_all", lambda sizes, born, links, m: taken.append((len(sizes), len(links))) or merge(sizes, born, links, m))
    options = dict(min_size=20, min_samples=12, k=24, trees=2, refine=0)
    whole = {r.id: (r.cluster, r.probability) for r in density_clusters(df, few=100_000, **options).collect()}
    assert taken.pop()[1] < len(x) and "pairs" not in made
    parts = {r.id: (r.cluster, r.probability) for r in density_clusters(df, few=0, **options).collect()}
    assert 0 < made.count("pairs") <= 4 and taken[0][1] < taken[0][0] <= len(x) // 20
    assert parts == whole and len({c for c, _ in whole.values()}) > 2


def test_trees_too_large_for_a_task(spark, monkeypatch):
    x = np.random.default_rng(5).normal(0, 0.2, (40, 2)) + np.repeat([[0.0, 0.0], [3.0, 0.0]], 20, axis=0)
    df, options = frame(spark, x), dict(min_size=4, k=12, few=0, trees=1, refine=0)
    want = sorted(density_clusters(df, **options).collect())
    monkeypatch.setattr(density, "TREE", 1)
    assert sorted(density_clusters(df, **options).collect()) == want and len({r.cluster for r in want}) > 1


def test_forest_of_many_tasks(spark):
    r = np.random.default_rng(4)
    links = sorted({(int(min(a, b)), int(max(a, b))) for a, b in r.integers(0, 60, (900, 2)) if a != b})
    links = [(a, b, float(w), a, b) for (a, b), w in zip(links, r.integers(1, 9, len(links)), strict=True)]
    df = spark.createDataFrame(links, "a long, b long, w double, e long, f long")
    parent = list(range(60))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    want = set()
    for a, b, w, e, f in sorted(links, key=lambda x: x[2:]):
        if root(a) != root(b):
            parent[root(b)] = root(a)
            want.add((a, b, w, e, f))
    assert {tuple(r) for r in density.spanning_forest(Workspace(spark), df, 60, rows=100).collect()} == want
    assert density.spanning_forest(Workspace(spark), df.limit(0), 0).collect() == []


def test_topics_by_density(spark):
    x, truth = planted()
    df = spark.createDataFrame([(f"r{i:03d}", [float(v) for v in row]) for i, row in enumerate(x)], "record_id string, vector array<double>")
    got = {r.record_id: (r.topic_id, r.assigned_probability) for r in cluster_topics(df, min_size=12, components=0).collect()}
    assert len(got) == len(x) and {t for t, _ in got.values()} >= {-1, 0, 1, 2} and all(0 <= p <= 1 for _, p in got.values())
    ids = df.selectExpr("cast(substr(record_id, 2) as long) as id", "vector as v")
    flat = np.array([r.v for r in principal(ids, 3).collect()])
    assert flat.shape == (len(x), 3) and np.allclose(flat.var(0), np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:3])
