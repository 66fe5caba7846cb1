"""Isotonic regression over ranges of scores, pooled in rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import MOST_RANGES, RANGE_ROWS
from tessera.runtime import Workspace

SCHEMA = "_range int, from_score double, n long, k double"


def pool(rows, out: list | None = None) -> list[list]:
    """Neighbouring (range, score, n, k) of falling or equal means k / n pooled; each pool keeps the range and score of its first row."""
    out = [] if out is None else out
    for r, s, n, k in rows:
        out.append([r, s, n, k])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, _, n1, k1 = out.pop()
            out[-1][2] += n1
            out[-1][3] += k1
    return out


def _frame(pools: list[list]) -> pd.DataFrame:
    return pd.DataFrame(pools, columns=["_range", "from_score", "n", "k"]).astype({"_range": "int32", "from_score": "float64", "n": "int64", "k": "float64"})


def _each(frames):
    out: list[list] = []
    for f in frames:
        pool(f.itertuples(index=False), out)
    yield _frame(out)


def _seam(f: pd.DataFrame) -> pd.DataFrame:
    return _frame(pool(f.sort_values("from_score")[["_range", "from_score", "n", "k"]].itertuples(index=False)))


def open_seams(edges: list) -> list[tuple[int, int, float, float]]:
    """Of the first and last step of every range, in order: neighbours (left, right, last mean, first mean) that must be pooled, no range twice."""
    out, i = [], 0
    while i + 1 < len(edges):
        a, b = edges[i], edges[i + 1]
        if a["last"]["k"] * b["first"]["n"] >= b["first"]["k"] * a["last"]["n"]:
            out.append((a["_range"], b["_range"], a["last"]["k"] / a["last"]["n"], b["first"]["k"] / b["first"]["n"]))
            i += 1
        i += 1
    return out


def isotonic(df: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(from_score, n, value): steps of the rising least-squares fit of y on score.

    Pooling neighbours that fall gives the same fit in any order. Ranges of
    distinct scores are pooled where they lie; then neighbouring ranges whose
    seam falls are joined in rounds, and only the steps that the seam can reach
    move: those on the left not under the right's first mean, and those on the
    right not over the left's last. Ranges that are swallowed vanish, so a pool
    over all of them takes about log2 of their number rounds. A task holds two
    ranges at most, the driver the first and last step of each.
    """
    ws = Workspace(df.sparkSession, rest=2.0)
    steps = ws.keep(df.groupBy(F.col("score").cast("double").alias("from_score")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("double")).alias("k")), "steps")
    parts = max(1, min(MOST_RANGES, -(-steps.count() // range_rows)))
    dealt = steps.repartitionByRange(parts, "from_score").sortWithinPartitions("from_score")
    cur = ws.keep(dealt.select(F.spark_partition_id().alias("_range"), "from_score", "n", "k").mapInPandas(_each, SCHEMA), "pools")
    ws.drop(steps)
    while parts > 1:
        step = F.struct("n", "k")
        seams = open_seams(cur.groupBy("_range").agg(F.min_by(step, "from_score").alias("first"), F.max_by(step, "from_score").alias("last")).orderBy("_range").collect())
        if not seams:
            break
        marks = [(a, i, True, first) for i, (a, _, _, first) in enumerate(seams)] + [(b, i, False, last) for i, (_, b, last, _) in enumerate(seams)]
        marked = cur.join(F.broadcast(df.sparkSession.createDataFrame(marks, "_range int, seam int, left boolean, mean double")), "_range", "left")
        slack = F.abs("mean") * 1e-12
        mean = F.col("k") / F.col("n")
        near = F.coalesce(F.when(F.col("left"), mean >= F.col("mean") - slack).otherwise(mean <= F.col("mean") + slack), F.lit(False))
        kept = marked.where(~near).select("_range", "from_score", "n", "k")
        joined = marked.where(near).groupBy("seam").applyInPandas(_seam, SCHEMA)
        nxt = ws.keep(kept.unionByName(joined), "pools")
        ws.drop(cur)
        cur = nxt
    return cur.select("from_score", "n", (F.col("k") / F.col("n")).alias("value"))
