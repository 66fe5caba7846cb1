"""Components with hubs and many small tasks, against a plain search."""

import random

from tessera.operators import graph
from tessera.operators.graph import connected_components


def test_hubs_and_tasks_that_follow_the_edges(spark, monkeypatch):
    r = random.Random(2)
    edges = [(5, i) for i in range(100, 400)] + [(900, i) for i in range(380, 700)] + [(r.randrange(2000, 2600), r.randrange(2000, 2600)) for _ in range(200)] + [(3000 + i, 3001 + i) for i in range(60)] + [(7, 7), (None, 8)]
    head = {x: x for e in edges for x in e if None not in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a is not None and head[a] != head[b]:
                head[a] = head[b] = min(head[a], head[b])
                moved = True
    df = spark.createDataFrame(edges, "src long, dst long")
    asked, real = [], graph.tasks_for
    monkeypatch.setattr(graph, "tasks_for", lambda n, rows: asked.append(real(n, rows)) or asked[-1])
    for rows, hub in ((100, 50), (10_000, 10_000)):
        got = connected_components(df, rows=rows, hub=hub)
        assert {x.node: x.component for x in got.collect()} == head
    assert asked[0] == -(-2 * (len(edges) - 1) // 100) and asked[-1] == 8
