import random

import pytest

from tessera.llm import decontaminate as D
from tessera.llm.near_dedup import near_groups

R = random.Random(4)
VOCAB = ["".join(R.choice("abcdefghijklm") for _ in range(R.randint(2, 7))) for _ in range(3000)]


def say(k):
    return " ".join(R.choice(VOCAB) for _ in range(k))


def brute(text, items):
    """Whether some stretch of the text holds three quarters of an item's words in order."""
    words = D.plain(text).decode().split()
    for item in items:
        own = D.plain(item).decode().split()
        n = len(own)
        for at in range(0, max(1, len(words) - n // 2), max(1, n // 4)):
            if D.lcs(own, words[at : at + n + n // 2]) >= 0.75 * n:
                return True
    return False


@pytest.fixture(scope="module")
def case(spark):
    items = [(i, say(R.randint(15, 50))) for i in range(120)] + [(120, say(300)), (None, say(30)), (122, None), (123, " !? ")]
    rows = []
    for k in range(160):
        text = say(R.randint(20, 200))
        if k % 2 == 0:
            words = items[R.randrange(122)][1].split()
            words = [R.choice(VOCAB) if R.random() < (k % 3) * 0.08 else w for w in words]  # verbatim and paraphrased
            text = f"{text} {' '.join(words)} {say(40)}"
        rows.append((k, text, "x"))
    rows += [(160, None, "x"), (161, "", "x"), (None, items[3][1], "x"), (2, rows[2][1], "x"), (162, say(20) + " " + items[121][1], "x"), (163, "z " * 60_000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, row string"), spark.createDataFrame(items, "item_id long, text string"), rows, items


def test_leaks_against_brute_force(case):
    docs, bench, rows, items = case
    got = [(r.doc_id, r.contaminated, r.item_id) for r in D.find_contaminated(docs, bench, common=0.2).collect()]
    assert sorted(str(g[0]) for g in got) == sorted(str(r[0]) for r in rows)
    texts = [t for _, t in items if t and t.strip(" !?")]
    want = {r[0] for r in rows if r[1] and len(r[1]) < 50_000 and brute(r[1], texts)}
    found = {g[0] for g in got if g[1]}
    assert len(found & want) >= 0.9 * len(want) and found <= want
    assert {g[2] for g in got if g[0] == 162 and g[1]} == {None}  # an item without an id
    assert not any(g[1] for g in got if g[0] in (160, 161, 163))


def test_blocks_of_items_find_what_one_block_finds(case):
    docs, bench, *_ = case
    few = D.find_contaminated(docs, bench, common=0.2, item_block=40, most_terms=2000)
    one = D.find_contaminated(docs, bench, common=0.2)
    key = lambda df: sorted((str(r.doc_id), r.contaminated) for r in df.collect())
    assert key(few) == key(one)


def test_nothing_to_read(case):
    docs, bench, *_ = case
    assert D.find_contaminated(docs.limit(0), bench).count() == 0
    assert not D.find_contaminated(docs, bench.limit(0)).where("contaminated").count()


def test_near_copies_that_share_a_passage_with_many(spark):
    """A passage that all documents share neither hides near copies nor joins others; groups equal all pairs."""
    passage = say(40)
    texts = []
    for k in range(60):
        base = say(200).split()
        texts.append(" ".join([*base, passage]))
        if k % 3 == 0:
            texts += [" ".join([*base[:100], say(2), *base[104:], passage]), " ".join([passage, *base])]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    want = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    assert got == want
