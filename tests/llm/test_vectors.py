"""Near-duplicate embeddings and whitening against brute force in numpy."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, whitening
from tessera.llm.embedding_dedup import near_vectors, strip_links, unite
from tessera.llm.vectors import summed
from tessera.llm.whitening import lanczos, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def planted(seed=5, dim=20):
    """Clusters of several widths, equal vectors, a chain, and vectors that link with nothing."""
    r = np.random.default_rng(seed)
    rows = []
    add = lambda v, label: rows.append((len(rows) + 10, None if v is None else [None if x is None else float(x) for x in v], label))
    for width in (0.02, 0.06, 0.075, 0.09, 0.3):
        centre = r.standard_normal(dim) / math.sqrt(dim)
        for _ in range(40):
            add(centre + width * r.standard_normal(dim), int(r.integers(0, 3)))
    same = r.standard_normal(dim)
    for i in range(30):
        add(same * (1 + (i % 2)), 1)
    for k in range(25):  # a chain: neighbours are near, ends are not
        a = 0.3 * k
        add([math.cos(a), math.sin(a)] + [0.0] * (dim - 2), 2)
    for bad in (None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] * dim, [None] + [1.0] * (dim - 1), [1.0, 0.0], [1.0, 0.01]):
        add(bad, 1)
    add([-0.0] + list(same[1:]), 0)
    add([0.0] + list(same[1:]), 0)
    add(same, None)
    add(same, None)
    return rows


def brute(rows, t):
    n = len(rows)
    unit = []
    for _, v, label in rows:
        ok = v is not None and len(v) and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, dtype=np.float32).astype(float) if ok else None
        unit.append(x / np.sqrt((x * x).sum()) if ok else None)
    parent, links = list(range(n)), [0] * n

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= t:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        ids = [x for x in (least.get(root(i)), rows[i][0]) if x is not None]
        least[root(i)] = min(ids, default=None)
    return Counter((rows[i][0], links[i], least[root(i)], rows[i][0] == least[root(i)]) for i in range(n))


@pytest.mark.parametrize("strip_bytes", [embedding_dedup.STRIP_BYTES, 2000])
def test_near_vectors_match_brute_force(spark, strip_bytes):
    rows = planted()
    got = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), strip_bytes=strip_bytes)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = brute(rows, 0.93)
    assert Counter(map(tuple, got.collect())) == want
    assert sum(n > 0 for _, n, *_ in want) > 60 and any(c != i for i, _, c, _ in want)


def test_other_types_thresholds_repeated_and_missing_ids(spark):
    rows = [(i, v if v is None else [x for x in v], label) for i, v, label in planted(9)]
    rows += [(rows[3][0], rows[3][1], rows[3][2]), (None, rows[3][1], rows[3][2]), (None, rows[4][1], rows[4][2]), (rows[5][0], rows[8][1], rows[8][2])]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumns({"embedding": F.col("embedding").cast("array<double>"), "label": F.col("label").cast("string"), "key": F.lit(1), "node": F.lit("x"), "n": F.lit(2), "v": F.lit(0), "least": F.lit(0)})
    for t in (0.8, 0.99):
        assert Counter(map(tuple, near_vectors(df, threshold=t).collect())) == brute(rows, t)
    with pytest.raises(ValueError):
        near_vectors(df, threshold=0.0)


def test_near_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_vectors(empty).collect() == []
    bad = spark.createDataFrame([(1, None, 1), (None, [0.0], 1)], SCHEMA)
    assert Counter(map(tuple, near_vectors(bad).collect())) == Counter([(1, 0, 1, True), (None, 0, None, True)])


def test_huge_and_tiny_entries(spark):
    rows = [(1, [1e300, 1e300], 1), (2, [1e-300, 1e-300], 1), (3, [1e300, -1e300], 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)])


def test_pairs_that_cannot_reach_are_left_early(monkeypatch):
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 64)) * np.linspace(3, 0.1, 64)
    strip = embedding_dedup.Strip(np.arange(600), np.ones(600, dtype=np.int64), x, None)
    stops = []
    real = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: stops.append(len(a[1])) or real(*a))
    node, links, _ = strip_links(strip, None, 0.93)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.93).sum(1) - 1
    assert dict(zip(node.tolist(), links.tolist(), strict=True)) == {i: int(n) for i, n in enumerate(want) if n}
    assert max(stops, default=0) < 600 * 600 / 4  # most pairs never see the later dimensions


def test_unite():
    parent = np.arange(8)
    unite(parent, np.array([7, 6, 2]), np.array([6, 2, 5]))
    unite(parent, np.array([0]), np.array([1]))
    assert parent.tolist() == [0, 0, 2, 3, 4, 2, 2, 2]


def test_sums_of_many_partitions(spark):
    df = spark.range(0, 500, 1, 200).selectExpr("id")
    assert summed(df, lambda bs: sum((np.array([b.num_rows, sum(b.column(0).to_pylist())]) for b in bs), np.zeros(2, dtype=np.int64)), (2,), np.int64).tolist() == [500, 499 * 250]


# ---- whitening -------------------------------------------------------------


def whitened_by_numpy(vectors, k=8):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=np.int64)
    n, s = len(x), x.sum(0)
    z = x - s / n
    cov = z.T @ z / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), z @ v, e, e / np.trace(cov)


def check_white(got, rows, vectors, k=8):
    n, deviation, proj, e, share = whitened_by_numpy(vectors, k)
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(by) == list(range(1, min(k, len(vectors[0])) + 1))
    live = e > 1e-9 * e[0]
    for c, of in by.items():
        have = [of[i].pop(0) for i in rows]
        assert all(r.n == n for r in have) and [r.deviation for r in have] == deviation.tolist()
        assert abs(have[0].explained - (share[c - 1] if live[c - 1] else 0)) <= 1e-10 and have[0].identity_error <= 1e-10
        if live[c - 1]:
            w = np.array([r.whitened for r in have])
            p = proj[:, c - 1] / math.sqrt(e[c - 1])
            assert min(np.abs(w - p).max(), np.abs(w + p).max()) < 1e-8
        else:
            assert all(r.whitened is None for r in have)


VEC = "vec_id long, embedding array<float>"


def test_whitening_matches_numpy(spark):
    r = np.random.default_rng(4)
    x = (r.standard_normal((300, 24)) * np.linspace(2, 0.2, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [None] + [1.0] * 23), (902, [float("nan")] * 24), (903, [float("-inf")] + [0.0] * 23), (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame(rows + bad, VEC).repartition(5).withColumns({"id": F.lit("x"), "v": F.lit(1), "dim": F.lit(2)})
    got = whiten(df, block=4).collect()
    assert len(got) == 300 * 8
    check_white(got, [i for i, _ in rows], [v for _, v in rows])


def test_whitening_of_equal_few_and_short_vectors(spark):
    same = [(i, [0.5, 0.25, -1.0]) for i in range(4)]
    got = whiten(spark.createDataFrame(same, VEC)).collect()
    assert len(got) == 12 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in got)
    flat = [(7, [0.0, 1.0, 0.0, 2.0]), (7, [3.0, 1.0, 0.0, 2.0]), (8, [3.0, 1.0, 0.5, 2.0]), (9, [3.0, 1.0, 0.5, 2.0])]
    check_white(whiten(spark.createDataFrame(flat, VEC)).collect(), [7, 7, 8, 9], [v for _, v in flat])
    assert whiten(spark.createDataFrame([], VEC)).collect() == []
    assert [r.vec_id for r in whiten(spark.createDataFrame([(None, [1.0])], VEC)).collect()] == [None]


def test_deviations_stay_exact_beyond_doubles(spark):
    rows = [(1, [2e5, 3e4]), (2, [-2e5, 500.5]), (3, [3e5, -1e4])]
    check_white(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), [1, 2, 3], [v for _, v in rows])
    far = [(1, [1e12]), (2, [-1e12])]
    got = whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in got] == [None, None] and all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in got)
    assert whitening.total_deviation(spark.createDataFrame(far, "vec_id long, v array<double>").select("v"), 1, whitening.Fit(2, np.array([0]), np.array([0]), 1024, 0)) == 2 * (2 * 1024 * 10**12) ** 2


def test_lanczos_restarts_after_breakdown():
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((40, 40)))
    for spectrum in ([5.0] * 20 + [1.0] * 20, [9.0] + [0.0] * 39, list(range(40, 0, -1)), [0.0] * 40):
        a = (q * np.array(spectrum)) @ q.T
        values, vectors = lanczos(lambda x, a=a: a @ x, 40, 8, block=4)
        assert np.allclose(values, sorted(spectrum, reverse=True)[:8], atol=1e-12 * 40)
        assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12) and np.linalg.norm(a @ vectors - vectors * values) < 1e-11
