"""Bootstrap draws against plain hashes, one unit and replicate at a time."""

import hashlib

import numpy as np
import pytest

from tessera.operators import draws
from tessera.operators.draws import cumulative, drawn_sums, heads


def head(text):
    return int.from_bytes(hashlib.sha1(text.encode()).digest()[:4], "big")


def test_hashes_of_arrays(monkeypatch):
    tails = ["", "|1", "|é", "|" + "x" * 60, *[f"|{i * i}" for i in range(50)]]
    for lanes in (7, 64, 4096):
        monkeypatch.setattr(draws, "LANES", lanes)
        got = {}
        for rs, at, h in heads(613, np.arange(95, 112), [t.encode() for t in tails]):
            got |= {(int(r), t): int(x) for r, row in zip(rs, h, strict=True) for t, x in zip(tails[at], row, strict=True)}
        assert got == {(r, t): head(f"613|{r}{t}") for r in range(95, 112) for t in tails}


def test_weighted_sums(spark):
    rows = [(i, i % 7, 3 * i) for i in range(300)] + [(None, 5, 1)]
    df = spark.createDataFrame(rows, "g long, a long, b long")
    out = drawn_sums(df, "g", ["a", "b"], 12, 7)
    # units are not multiplied into rows by replicate
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for r in range(12):
        w = [sum(head(f"7|{r}" if g is None else f"7|{r}|{g}") / 2**32 >= c for c in cumulative()) for g, _, _ in rows]
        want[r] = (sum(x * a for x, (_, a, _) in zip(w, rows, strict=True)), sum(x * b for x, (_, _, b) in zip(w, rows, strict=True)))
    assert {x.replicate: (x.a, x.b) for x in out.collect()} == want
    assert drawn_sums(df.limit(0), "g", ["a", "b"], 12, 7).collect() == []


def test_most_draws_are_few():
    assert cumulative()[0] == pytest.approx(np.exp(-1)) and 1 - cumulative()[-1] < 1.1e-5
