"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import Workspace, tasks_for

ROWS = 500_000  # edges that one task of an exchange takes
HUB = 500_000  # edges from which on a node is a hub


def _lowest(pairs: DataFrame, tasks: int) -> DataFrame:
    """(u, m, n): the smallest neighbour of every u, and how many edges it has."""
    return pairs.repartition(tasks, "u").groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _with_lowest(pairs: DataFrame, low: DataFrame, tasks: int, hub: int) -> DataFrame:
    """``pairs`` with the ``m`` of their u. Edges of a hub meet it by a broadcast, where they are: no task sorts a whole hub."""
    hubs = [(r["u"], r["m"]) for r in low.where(F.col("n") > hub).select("u", "m").collect()]  # at most one for ``hub`` edges
    if not hubs:
        return pairs.repartition(tasks, "u").join(low.select("u", "m").repartition(tasks, "u"), "u")
    table = pairs.sparkSession.createDataFrame(hubs, low.select("u", "m").schema)
    rest = pairs.join(F.broadcast(table.select("u")), "u", "left_anti").repartition(tasks, "u").join(low.where(F.col("n") <= hub).select("u", "m").repartition(tasks, "u"), "u")
    return rest.select("u", "v", "m").union(pairs.join(F.broadcast(table), "u").select("u", "v", "m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, rows: int = ROWS, hub: int = HUB) -> DataFrame:
    """Smallest reachable node of each node that has an edge.

    Alternating large-star and small-star contraction: each round is two
    aggregations by node, with the neighbour lists never built (a node meets
    only the minimum of its neighbourhood). Exchanges have a task for ``rows``
    edges, and nodes of more than ``hub`` edges are not dealt to one task where
    it would hold them, so no task's memory grows with the input. Rounds grow
    with the logarithm of the longest path. Each round's edges are written to
    the shared folder, which cuts the lineage.

    Null endpoints are ignored; self loops give a component of one node.
    Returns (node, component); a node of no edge is absent.
    """
    ws = Workspace(edges.sparkSession)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    cur = ws.keep(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    n_edges, before = cur.count(), None
    for _ in range(max_rounds):
        tasks = tasks_for(2 * n_edges, rows)
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.keep(_lowest(both, tasks).withColumn("m", F.least("u", "m")), "lowest")
        # large star: every larger neighbour of u hangs on the minimum around u
        large = _with_lowest(both.where("v >= u"), low, tasks, hub).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ws.keep(large.repartition(tasks, "u", "v").distinct(), "large")
        # small star: u and its smaller neighbours hang on the smallest of them
        low2 = ws.keep(_lowest(large, tasks), "lowest")
        small = _with_lowest(large, low2, tasks, hub).select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = ws.keep(small.union(low2.select("u", F.col("m").alias("v"))).repartition(tasks, "u", "v").distinct(), "edges")
        mark = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for t in (cur, low, large, low2):
            ws.drop(t)
        cur, n_edges = nxt, mark[0]
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.repartition(tasks_for(n_edges, rows), "u").groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
