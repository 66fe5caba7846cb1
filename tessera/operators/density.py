"""Density clusters of vectors: a mutual-reachability hierarchy, condensed, with the most stable clusters.

1. An approximate nearest-neighbour graph (``neighbours``) gives each vector
   its core distance, the distance to its ``min_samples``-th neighbour; a link
   weighs the largest of its length and both core distances.
2. Single linkage over that graph by Borůvka rounds. In a round every
   component of fewer than ``min_size`` vectors points along its lightest
   outgoing link (links are ordered by weight, then ends, so none are equal).
   Two that point at each other merge, and that is a step of the hierarchy:
   neither can meet anything sooner. Reaching ``min_size`` a cluster is born.
   A small component whose pointers lead to a cluster falls out of it at the
   weight of its own pointer: until that weight it stays as it is, and what it
   points at belongs to the cluster by then. So whole chains are settled in
   one round. Components whose pointers lead to one pair meet in a task, which
   goes on merging and settling them as far as their links lead to each other
   (``contract``): a hub takes up its neighbours in one round, not one a round.
3. Clusters, at most one for ``min_size`` vectors, and a spanning forest of the
   links between them, made by tasks, are the condensed problem; the driver
   merges them in order of weight. (Once ``few`` small components or fewer are
   open it takes them as well: the steps are the same.)

Joins of the rounds go by exchanges: a table that is gathered at the driver to
be sent round would be so in every round.
4. A cluster's stability is the sum over its vectors of 1 / weight at which
   they leave it, less 1 / weight at which it split off. From the leaves up a
   cluster is kept if it is more stable than the kept ones below it; the root
   never is. Vectors that fall out above every kept cluster are outliers (-1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.neighbours import neighbour_graph
from tessera.runtime import Workspace, tasks_for

NEAREST = 1e-9  # weights below count as this, so that copies have a finite density
ROWS = 500_000  # links that one task contracts
TREE = 20_000  # components of one pointer tree that meet in a task; of a larger tree only its pair does
LINK = "struct<w:double,e:bigint,f:bigint>"


def _met(one: DataFrame, two: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by exchanges, with no table gathered at the driver."""
    return one.join(two.hint("merge"), on, how)


def reachability(graph: DataFrame, min_samples: int) -> DataFrame:
    """(a, b, w), a < b: links with mutual-reachability weights."""
    core = graph.groupBy("id").agg(F.sort_array(F.collect_list("d")).alias("ds"))  # at most k numbers an id
    core = core.select("id", F.element_at("ds", F.least(F.lit(min_samples), F.size("ds"))).alias("core"))
    links = graph.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))
    links = _met(_met(links, core.select(F.col("id").alias("a"), F.col("core").alias("ca")), "a"), core.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b")
    return links.select("a", "b", F.greatest("d", "ca", "cb", F.lit(NEAREST)).alias("w"))


def contract(c: np.ndarray, size: np.ndarray, t: np.ndarray, w: np.ndarray, e: np.ndarray, f: np.ndarray, min_size: int) -> Iterator[tuple[int, int, tuple | None, tuple | None]]:
    """(component, where it goes, link by which it falls out of that cluster or None, link by which that is born or None).

    The rows are, of every small component ``c`` here, its ``min_size`` lightest
    links to others ``t``: fewer than ``min_size`` of them can end inside what
    it is merged with before that is a cluster. Components whose lightest link
    leads to none of ``c`` stay as they are.
    """
    order = np.lexsort((f, e, w, c))
    ids, first = np.unique(c[order], return_index=True)
    rows = list(zip(*(x[order].tolist() for x in (w, e, f, t)), strict=True))
    ends = [*first.tolist(), len(rows)][1:]
    heaps = {x: rows[i:j] for x, i, j in zip(ids.tolist(), first.tolist(), ends, strict=True)}
    sizes = dict(zip(ids.tolist(), size[order][first].tolist(), strict=True))
    up, parts, born, left = {x: x for x in heaps}, {x: [x] for x in heaps}, {}, {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def nearest(x: int) -> tuple[tuple | None, int | None]:
        h = heaps[x]
        while h and root(h[0][3]) == x:
            heappop(h)
        return (h[0][:3], root(h[0][3])) if h else (None, None)

    open_ = list(heaps)
    while open_:
        a = open_.pop()
        if up[a] != a or a in born:
            continue
        link, b = nearest(a)
        if b not in up or b in born or nearest(b)[0] != link:
            continue
        if len(heaps[a]) < len(heaps[b]):
            a, b = b, a
        up[b] = a
        sizes[a] += sizes[b]
        parts[a] += parts.pop(b)
        if sizes[a] >= min_size:
            born[a] = link
            left.update(dict.fromkeys(parts[a], link))
        else:
            for x in heaps.pop(b):
                heappush(heaps[a], x)
            open_.append(a)
    home = {x: x for x in born}
    for a in [x for x in parts if x not in born]:
        path, x = [], a
        while x in up and x not in home:
            path.append((x, nearest(x)))
            home[x] = None
            x = path[-1][1][1]
        for y, (link, _) in path:
            home[y] = home.get(x)
            if home[y] is not None:
                left.update(dict.fromkeys(parts[y], link))
    for a, own in parts.items():
        if home[a] is not None or len(own) > 1:
            for x in own:
                yield x, a if home[a] is None else home[a], left.get(x), born.get(x)


def spanning_forest(ws: Workspace, links: DataFrame, nodes: int, rows: int = 200_000) -> DataFrame:
    """Links (a, b, w, e, f) less the heaviest of every cycle: fewer than ``nodes``. A task takes four links a node, or ``rows``."""

    def lightest(batches):
        t = pa.Table.from_batches(list(batches), schema=schema).sort_by([(x, "ascending") for x in ("w", "e", "f")])
        up: dict[int, int] = {}
        keep = np.zeros(t.num_rows, bool)
        for i, (a, b) in enumerate(zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True)):
            for x in (a, b):
                up.setdefault(x, x)
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            if a != b:
                up[b], keep[i] = a, True
        yield from t.filter(pa.array(keep)).to_batches()

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64()), ("e", pa.int64()), ("f", pa.int64())])
    while True:
        tasks = max(1, -(-links.count() // max(rows, 4 * nodes)))
        links = ws.keep(links.select(*schema.names).repartition(tasks).mapInArrow(lightest, "a long, b long, w double, e long, f long"), "forest")
        if tasks == 1:
            return links


@dataclass
class Tree:
    """Condensed clusters: link (weight, ends) by which each was formed, its weight, and its parent (-1: none)."""

    link: list[tuple] = field(default_factory=list)
    formed: list[float] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)

    def add(self, link: tuple, children: list[int] = ()) -> int:
        self.link.append(link)
        self.formed.append(link[0])
        self.parent.append(-1)
        for c in children:
            self.parent[c] = len(self.formed) - 1
        return len(self.formed) - 1

    def until(self, k: int) -> float:
        """Weight at which a cluster joins another."""
        return self.formed[self.parent[k]] if self.parent[k] >= 0 else np.inf

    def at(self, k: int, link: tuple) -> int:
        """The cluster that holds k when ``link`` is reached."""
        while self.parent[k] >= 0 and self.link[self.parent[k]] <= link:
            k = self.parent[k]
        return k


def merge_all(sizes: dict[int, int], born: dict[int, tuple], links: list[tuple], min_size: int) -> tuple[Tree, dict[int, int], dict[int, tuple[int, float]]]:
    """Tree, leaf cluster of every born component, and (cluster, weight) at which every other component falls out.

    ``links`` are (w, end, end, a, b) between components; components that meet
    no cluster are left out.
    """
    tree, leaf, fell = Tree(), {}, {}
    parent = {c: c for c in sizes}
    size, cluster, members = dict(sizes), {}, {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for c in sizes:
        if c in born:
            cluster[c] = leaf[c] = tree.add(born[c])
        else:
            members[c] = [c]

    def fall(c: int, k: int, w: float) -> None:
        for x in members.pop(c):
            fell[x] = (k, w)

    for w, e, f, a, b in sorted(links):
        a, b = root(a), root(b)
        if a == b:
            continue
        if size[a] < size[b]:
            a, b = b, a
        ka, kb = cluster.get(a), cluster.get(b)
        parent[b] = a
        size[a] += size[b]
        if ka is not None and kb is not None:
            cluster[a] = tree.add((w, e, f), [ka, kb])
        elif ka is not None:
            fall(b, ka, w)
        else:  # the smaller side is never a cluster alone
            members[a] += members.pop(b)
            if size[a] >= min_size:
                cluster[a] = tree.add((w, e, f))
                fall(a, cluster[a], w)
    tops = sorted({cluster[r] for r in {root(c) for c in sizes} if r in cluster})
    if len(tops) > 1:  # parts that no link joins split at density nought
        tree.add((np.inf, 0, 0), tops)
    return tree, leaf, fell


def select_clusters(tree: Tree, density: dict[int, float], count: dict[int, int]) -> list[int]:
    """Kept clusters: ``density`` sums 1 / weight over the vectors that leave each cluster, ``count`` numbers them."""
    n = len(tree.formed)
    children = [[] for _ in range(n)]
    for k, p in enumerate(tree.parent):
        if p >= 0:
            children[p].append(k)
    total = [0] * n
    for k in range(n):  # a parent is formed after its children
        total[k] += count.get(k, 0)
        if tree.parent[k] >= 0:
            total[tree.parent[k]] += total[k]
    best, kept = [0.0] * n, [False] * n
    for k in range(n):
        birth = 0.0 if np.isinf(tree.until(k)) else 1 / tree.until(k)
        split = 0.0 if np.isinf(tree.formed[k]) or not children[k] else 1 / tree.formed[k]
        stable = density.get(k, 0.0) - birth * count.get(k, 0) + sum(total[c] for c in children[k]) * (split - birth)
        below = sum(best[c] for c in children[k])
        kept[k] = tree.parent[k] >= 0 and (not children[k] or stable >= below)
        best[k] = stable if kept[k] else below
    out, open_ = [], [k for k in range(n) if tree.parent[k] < 0]
    while open_:
        k = open_.pop()
        if kept[k]:
            out.append(k)
        else:
            open_ += children[k]
    return sorted(out)


def density_clusters(vectors: DataFrame, *, min_size: int = 30, min_samples: int | None = None, k: int | None = None, few: int = 20_000, max_rounds: int = 200, **graph_options) -> DataFrame:
    """(id, cluster, probability): clusters numbered by falling size (ties: smallest id), outliers -1 with probability 0.

    ``vectors`` has id (long, unique) and v (arrays of one length).
    """
    if min_size < 2:
        raise ValueError("a cluster has two vectors at least")
    ws = Workspace(vectors.sparkSession, rest=2.0)
    spark = vectors.sparkSession
    samples = min_samples or min_size
    vectors = ws.keep(vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")), "vectors")
    graph = neighbour_graph(vectors, k or max(samples, 15), **graph_options)
    links = ws.keep(reachability(graph, samples).select("a", "b", "w", F.col("a").alias("e"), F.col("b").alias("f")), "links")
    nodes = ws.keep(vectors.select(F.col("id").alias("c"), F.lit(1).cast("long").alias("size"), F.lit(None).cast(LINK).alias("born")), "nodes")
    member = ws.keep(vectors.select("id", F.col("id").alias("c")), "members")  # of components that are no clusters
    settled = None  # (id, born component, and the link by which it fell out)

    def meet(batches):
        t = pa.Table.from_batches(list(batches), schema=pa.schema([(x, pa.float64() if x == "w" else pa.int64()) for x in ("c", "size", "t", "w", "e", "f")]))
        got = list(contract(*(t.column(x).to_numpy() for x in t.schema.names), min_size))
        link = pa.struct([("w", pa.float64()), ("e", pa.int64()), ("f", pa.int64())])
        c, r, out, born = zip(*got, strict=True) if got else [()] * 4
        out, born = (pa.array([x and dict(zip("wef", x, strict=True)) for x in xs], link) for xs in (out, born))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(r, pa.int64()), out, born], ["c", "r", "link", "born"])

    for _ in range(max_rounds):
        if nodes.where("born IS NULL").count() <= few:
            break
        out = links.select(F.col("a").alias("c"), F.col("b").alias("t"), "w", "e", "f").union(links.select(F.col("b").alias("c"), F.col("a").alias("t"), "w", "e", "f"))
        rank = Window.partitionBy("c").orderBy("w", "e", "f")
        near = _met(out, nodes.where("born IS NULL").select("c", "size"), "c").withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= min_size)
        near = ws.keep(near.select("c", "size", "t", "w", "e", "f", "rn"), "near")
        point = near.where("rn = 1").select("c", "t", F.struct("w", "e", "f").alias("link"))
        if point.isEmpty():
            break
        pair = ws.keep(_met(point, point.select(F.col("c").alias("t"), F.col("t").alias("c")), ["c", "t"]).where("c < t").select(F.col("c").alias("p"), F.col("t").alias("q")), "pairs")
        ends = pair.select(F.col("p").alias("c"), "p").union(pair.select(F.col("q").alias("c"), "p"))
        # where the pointers of a component lead: a pair or a cluster, by doubling
        lead = ws.keep(_met(point, ends, "c", "left").select("c", F.coalesce("p", "t").alias("r")), "leads")
        while True:
            far = lead.select(F.col("c").alias("r"), F.col("r").alias("r2"))
            nxt = ws.keep(_met(lead, far, "r", "left").select("c", F.coalesce("r2", "r").alias("r"), F.expr("coalesce(r2 <> r, false)").alias("moved")), "leads")
            ws.drop(lead)
            lead = nxt
            if lead.where("moved").isEmpty():
                break
        # components that a cluster takes up, with the weight at which their vectors fall out of it
        taken = _met(_met(lead.select("c", "r"), nodes.where("born IS NOT NULL").select(F.col("c").alias("r")), "r"), point.select("c", "link"), "c").select("c", "r", "link", F.lit(None).cast(LINK).alias("born"))
        tree = _met(lead.select("c", "r"), pair.select(F.col("p").alias("r")), "r")
        tree = _met(_met(tree, tree.groupBy("r").agg(F.count("*").alias("n")), "r"), ends, "c", "left").where((F.col("n") <= TREE) | F.col("p").isNotNull()).select("c", "r")
        whole = _met(near, tree, "c").repartition(tasks_for(near.count(), ROWS), "r").select("c", "size", "t", "w", "e", "f")
        moves = ws.keep(taken.unionByName(whole.mapInArrow(meet, f"c long, r long, link {LINK}, born {LINK}")), "moves")
        gone = _met(member, moves.where("link IS NOT NULL"), "c").select("id", F.col("r").alias("born"), "link.*")
        gone = ws.keep(gone, "settled")
        settled = gone if settled is None else settled.unionByName(gone)
        old = (near, pair, lead, moves, member, nodes, links)
        member = ws.keep(_met(member, moves.select("c", "r", "link"), "c", "left").where("link IS NULL").select("id", F.coalesce("r", "c").alias("c")), "members")
        place = moves.select("c", "r")
        nodes = _met(nodes, moves.select("c", "r", F.col("born").alias("grown")), "c", "left")
        nodes = ws.keep(nodes.groupBy(F.coalesce("r", "c").alias("c")).agg(F.sum("size").alias("size"), F.max(F.coalesce("born", "grown")).alias("born")), "nodes")
        a, b = place.select(F.col("c").alias("a"), F.col("r").alias("ra")), place.select(F.col("c").alias("b"), F.col("r").alias("rb"))
        new = _met(_met(links, a, "a", "left"), b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "w", "e", "f").where("a <> b")
        least = new.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("w", "e", "f")).alias("m"))
        links = ws.keep(least.select("a", "b", "m.*"), "links")
        for t in old:
            ws.drop(t)
    else:
        raise RuntimeError(f"components were still open after {max_rounds} rounds")
    # at most `few` small components, one cluster for min_size vectors, and those that no link reaches
    linked = links.select(F.col("a").alias("c")).union(links.select(F.col("b").alias("c"))).distinct()
    rest = _met(nodes, linked, "c", "left_semi").unionByName(_met(nodes.where("born IS NOT NULL"), linked, "c", "left_anti")).collect()
    links = spanning_forest(ws, links, len(rest))
    tree, leaf, fell = merge_all({r["c"]: r["size"] for r in rest}, {r["c"]: tuple(r["born"]) for r in rest if r["born"] is not None}, [(r["w"], r["e"], r["f"], r["a"], r["b"]) for r in links.collect()], min_size)
    shared = spark.sparkContext.broadcast((tree, leaf, fell))

    def early(batches):
        tree, leaf, _ = shared.value
        for b in batches:
            born, *link = (b.column(c).to_pylist() for c in ("born", "w", "e", "f"))
            at = [tree.at(leaf[c], x) for c, x in zip(born, zip(*link, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at, pa.int32()), b.column("w")], ["id", "k", "w"])

    def late(batches):
        fell = shared.value[2]
        for b in batches:
            got = [fell.get(c, (-1, None)) for c in b.column("c").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.float64())], ["id", "k", "w"])

    placed = member.select("id", "c").mapInArrow(late, "id long, k int, w double")
    if settled is not None:
        placed = placed.unionByName(settled.mapInArrow(early, "id long, k int, w double"))
    placed = ws.keep(placed, "placed")
    sums = placed.where("k >= 0").groupBy("k").agg(F.sum(1 / F.col("w")).alias("density"), F.count("*").alias("n"), F.max(1 / F.col("w")).alias("top")).collect()  # a row a cluster
    kept = select_clusters(tree, {r["k"]: r["density"] for r in sums}, {r["k"]: r["n"] for r in sums})
    chosen, within = set(kept), {}
    for x in reversed(range(len(tree.formed))):  # a parent comes before its children
        at = x if x in chosen else within.get(tree.parent[x])
        if at is not None:
            within[x] = at
    top = {r["k"]: r["top"] for r in sums}
    for x, p in enumerate(tree.parent):  # the split of a kept cluster counts as a density that it reached
        if p in within and within[p] == p and not np.isinf(tree.formed[p]):
            top[p] = max(top.get(p, 0.0), 1 / tree.formed[p])
    if not within:
        return vectors.select("id", F.lit(-1).alias("cluster"), F.lit(0.0).alias("probability"))
    table = spark.createDataFrame([(x, r, top.get(r, 0.0)) for x, r in within.items()], "k int, r int, top double")
    own = ws.keep(placed.join(F.broadcast(table), "k", "left").select("id", "r", F.when(F.col("r").isNotNull(), F.least(1 / F.col("w"), F.col("top")) / F.col("top")).otherwise(0.0).alias("probability")), "own")
    order = own.where("r IS NOT NULL").groupBy("r").agg(F.count("*").alias("n"), F.min("id").alias("low")).orderBy(F.desc("n"), "low").collect()
    names = spark.createDataFrame([(r["r"], i) for i, r in enumerate(order)], "r int, cluster int")
    return own.join(F.broadcast(names), "r", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "probability")
