import hashlib
import random
import re
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import xxhash

from tessera.llm.exact_dedup import dedup_exact, drop_exact, maybe_repeated
from tessera.llm.golay import decode, near_keys
from tessera.llm.near_dedup import drop_near, near_groups
from tessera.llm.simhash import links_within_two, simhash_groups
from tessera.llm.substring_dedup import _hot_minimisers, dedup_windows
from tessera.llm.suffix_dedup import _hot_samples, dedup_suffixes
from tessera.llm.suffix_ranks import dedup_by_ranks
from tessera.operators.graph import connected_components


def key(i):
    return float("inf") if i is None else i


def test_suffix_dedup_matches_brute_force(docs):
    rows = docs.collect()
    first = {}
    for r in sorted(rows, key=lambda r: key(r.doc_id)):
        t = (r.text or "").encode()
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], key(r.doc_id))
    want = []
    for r in rows:
        t = (r.text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < key(r.doc_id):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        want.append((r.doc_id, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept))
    for f, size in ((dedup_suffixes, 1 << 10), (partial(dedup_suffixes, hot_windows=9), 1 << 10), (dedup_suffixes, 8 << 20), (dedup_by_ranks, 1 << 16)):  # many blocks, one block
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept_text)) for r in f(docs, block_bytes=size).collect()]
        assert Counter(got) == Counter(want)
    assert any(w[2] for w in want)


def test_suffix_dedup_odd_threshold(docs):
    rows = docs.where("doc_id < 40").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        t = (r.text or "").encode()
        for i in range(len(t) - 20):
            first.setdefault(t[i : i + 21], r.doc_id)
    for hot in (1, 30, 1 << 30):
        got = {r.doc_id: r.n_removed for r in dedup_suffixes(docs.where("doc_id < 40").dropDuplicates(["doc_id"]), min_len=21, block_bytes=1 << 11, hot_windows=hot).collect()}
        for r in rows:
            t = (r.text or "").encode()
            gone = bytearray(len(t))
            for i in range(len(t) - 20):
                if first[t[i : i + 21]] < r.doc_id:
                    gone[i : i + 21] = b"\1" * 21
            assert got[r.doc_id] == sum(gone)


def test_window_dedup_matches_brute_force(docs):
    rows = docs.collect()
    words = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    times = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if times[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((r.doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    for size, hot in ((1 << 10, 1 << 30), (8 << 20, 1 << 30), (1 << 10, 1), (1 << 10, 40), (8 << 20, 20)):
        got = [tuple(r) for r in dedup_windows(docs, block_bytes=size, hot_windows=hot).collect()]
        assert Counter(got) == Counter(want)
    assert any(w[2] for w in want)


def test_a_phrase_in_every_document_is_hot_and_spreads(spark):
    r = random.Random(5)
    say = lambda k: " ".join(f"w{r.randrange(10**6)}" for _ in range(k))
    phrase, rows = say(20), []
    for i in range(40):
        rows.append((i, f"{say(40)} {phrase} {say(40)}"))
    rows += [(90, rows[3][1]), (91, None), (92, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hot = _hot_minimisers(df, "text", 35, 8, sum(len(t or "") for _, t in rows), 200)
    assert 0 < len(hot) < 10
    got = {x.doc_id: x.n_removed for x in dedup_windows(df, hot_windows=200, block_bytes=1 << 10).collect()}
    assert got == {**{i: 0 for i, _ in rows}, 3: 100, 90: 100}


def test_hot_samples_are_found(spark):
    r = random.Random(6)
    say = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    phrase = say(45)
    rows = [(i, say(60) + phrase + say(60)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hot = _hot_samples(df, "text", 50, 40 * 165, 300)
    assert 0 < len(hot) < 4
    for limit in (300, 1 << 30):
        assert {x.n_removed for x in dedup_suffixes(df, hot_windows=limit, block_bytes=1 << 10).collect()} == {0}


def test_exact_dedup(docs):
    rows = docs.collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in rows]
    groups = defaultdict(list)
    for r, t in zip(rows, norm):
        groups[t].append(r.doc_id)
    want = []
    for r, t in zip(rows, norm):
        keep = min((i for i in groups[t] if i is not None), default=None)
        want.append((r.doc_id, keep, len(groups[t]), r.doc_id == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert Counter(tuple(r) for r in dedup_exact(docs).collect()) == Counter(want)
    # a filter of very few bits only sends more rows to the shuffle
    assert Counter(tuple(r) for r in dedup_exact(docs, max_bits=1 << 15).collect()) == Counter(want)
    kept = drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(key(r.doc_id) for r in kept.collect()) == sorted(min(map(key, g)) for g in groups.values())


def test_filter_never_misses_a_repeat(spark):
    df = spark.range(3000).selectExpr("xxhash64(id % 2900) AS x").repartition(5)
    flag = maybe_repeated(spark, df, "x", 3000)
    flagged = {r.x for r in df.where(flag("x")).collect()}
    again = {r.x for r in df.groupBy("x").count().where("count > 1").collect()}
    assert again <= flagged and len(flagged) < 3 * len(again)


def slow_fingerprint(text, words=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    at = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = at[i], at[j]
                at = [b if x == a else x for x in at]
    return at


def test_simhash_matches_brute_force(docs):
    rows = docs.collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    at = brute_components(prints)
    low = {}
    for r, c in zip(rows, at):
        low[c] = min(low.get(c, float("inf")), key(r.doc_id))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(docs).collect())
    assert got == Counter((r.doc_id, f"{f:016x}", low[c]) for r, f, c in zip(rows, prints, at))


def test_hot_key_groups_link_the_same_fingerprints(spark):
    r = np.random.default_rng(5)
    fps = set()
    for base in r.integers(-(2**62), 2**62, 2).tolist():
        for _ in range(150):
            x = base
            for b in r.integers(0, 63, r.integers(0, 4)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    want = brute_components(fps)
    for most in (4, 64):
        part = {r.node: r.component for r in connected_components(links_within_two(spark.createDataFrame([(x,) for x in fps], "fp long"), most=most)).collect()}
        got = [part.get(x, x) for x in fps]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_golay_code_is_perfect():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 23, 2000)
    for flips in range(3):
        y = x.copy()
        for _ in range(flips):
            y ^= 1 << r.integers(0, 23, len(y))
        a, b = near_keys(x), near_keys(y)
        assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist()))
        assert {len(set(p)) for p in a.tolist()} <= {1, 6}
    assert len(set(decode(np.arange(1 << 23)).tolist())) == 4096


def test_near_groups(spark):
    import random

    r = random.Random(1)
    say = lambda n: ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    rows, truth = [], {}
    for g in range(12):
        base = say(r.randint(80, 400))
        for k in range(5):
            w = list(base)
            for _ in range(k * len(w) // 220):
                w[r.randrange(len(w))] = "".join(r.choice("xyz") for _ in range(6))
            rows.append((len(rows), " ".join(w)))
            truth.setdefault(g, []).append(set(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    rows += [(900, None), (901, ""), (902, "alone"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    part = {x.doc_id: x.component_id for x in near_groups(df).collect()}
    for g, sets in truth.items():
        for a in range(5):
            for b in range(a):
                if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                    assert part[5 * g + a] == part[5 * g + b]
    assert all(v // 5 == k // 5 for k, v in part.items())
    kept = [x.doc_id for x in drop_near(df).collect()]
    assert {900, 901, 902, None, 0} <= set(kept) and len(kept) == len(rows) - sum(k != v for k, v in part.items())


def test_empty_tables(nothing):
    for f in (dedup_suffixes, dedup_by_ranks, dedup_windows, dedup_exact, drop_exact, simhash_groups, near_groups, drop_near):
        assert f(nothing).count() == 0


def shingle_sets(rows):
    w = {i: t.lower().split() for i, t in rows}
    return {i: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} or {tuple(x)} for i, x in w.items()}


def brute_near(rows, similarity=0.8):
    """Component of every document, over all pairs."""
    sets = shingle_sets(rows)
    at = {i: i for i in sets}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids[: ids.index(a)]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                at[y] = x
    return {i: top(i) for i in ids}


def near_rows(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_groups(df, **options).collect()}
    return {i: got.get(i, i) for i, _ in rows}


def test_near_copies_of_an_original_meet_it(spark):
    # copies are near their original (0.82) but not one another (0.69), and the original is the last by doc_id
    r = np.random.default_rng(8)
    base = [f"w{x}" for x in r.integers(0, 10**9, 300)]
    rows = [(999, " ".join(base))]
    for k in range(60):
        w = list(base)
        for j in range(6):
            w[10 + 50 * j + int(r.integers(0, 30))] = f"new{k}x{j}"
        rows.append((k, " ".join(w)))
    want = brute_near(rows)
    assert set(want.values()) == {0}
    assert near_rows(spark, rows) == want
    assert near_rows(spark, rows, block=2000) == want  # pairs of blocks


def edited_pairs(kind, n, seed):
    """Pairs of similarity 0.8 to 0.95 by one kind of edit: the first of each even, its copy odd."""
    r = np.random.default_rng(seed)
    say = lambda k: [f"w{x}" for x in r.integers(0, 10**9, k)]
    rows = []
    for k in range(n):
        size = int(r.integers(60, 400))
        a = say(size)
        b = list(a)
        if kind == "appended":
            b += say(size * 15 // 100 + 1)
        elif kind == "run":
            b[size // 3 : size // 3 + size // 13] = say(size // 13)
        else:
            for x in range(size // 60):
                b[60 * x + int(r.integers(5, 50))] = say(1)[0]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    return rows


def test_no_kind_of_edit_loses_pairs(spark):
    rows = []
    for x, kind in enumerate(("appended", "run", "scattered")):
        rows += [(1000 * x + i, t) for i, t in edited_pairs(kind, 40, x)]
    want = brute_near(rows)
    assert sum(want[i] != i for i, _ in rows) >= 100
    assert near_rows(spark, rows) == want


def test_repeated_passages_do_not_hide_copies(spark):
    r = np.random.default_rng(4)
    rows = []
    for size, times in ((60, 2), (150, 2), (500, 2), (100, 4), (200, 2)):
        text = " ".join(f"w{x}" for x in r.integers(0, 10**9, size))
        rows += [(len(rows), text), (len(rows) + 1, " ".join([text] * times))]
    want = brute_near(rows)
    assert all(want[i] == i - i % 2 for i, _ in rows)
    assert near_rows(spark, rows) == want
