"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors of one label are one node. Unit vectors are rotated onto the
principal directions of all nodes and sorted within their label by the leading
one into strips. Unit vectors of cosine t differ by at most sqrt(2 - 2t), so a
strip meets only the strips whose leading coordinates lie that near. Within a
pair of strips, tiles whose bounding boxes lie further apart are skipped; the
others add up their products dimension group by dimension group, leading ones
first, and after each group drop every pair whose partial sum plus the product
of the suffix norms (Cauchy-Schwarz) cannot reach the threshold. Rotation and
order only decide how much is skipped; cosines within 1e-9 of the threshold
are taken anew from the vectors as given, in double precision.

A pair of strips returns, for each vector, a count of its links and one link
to the head of its group of linked vectors in the two strips: never the pairs.

Definite results: a vector that is null, empty or zero, or holds null, NaN or
infinite entries, and one without a label, links with nothing; so do vectors
of different lengths. Rows are vectors of their own, also those that repeat an
id: equal ones link. A null id is never the smallest; a component of such rows
alone has a null id, and its rows are kept. An empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import released
from tessera.llm.vectors import common_length, matrix, summed, usable
from tessera.operators.graph import connected_components
from tessera.operators.relational import join_groups
from tessera.runtime import Workspace, tasks_for

STRIP_BYTES = 4 << 20
TILE = 512
STAGES = (8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096)
WIDEST = 512  # vectors of more dimensions keep the order of their dimensions
SLACK = 1e-9
SPARSE = 16  # pairs are followed one by one once fewer than a sixteenth of a tile pair is alive


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; entries near the ends of the range neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotation(nodes: DataFrame, dim: int) -> np.ndarray | None:
    """Principal directions of the unit vectors of the most frequent length, falling; none if they are too wide."""
    if not 0 < dim <= WIDEST:
        return None

    def work(batches):
        out = np.zeros((dim, dim))
        for b in batches:
            c = b.column(0)
            for at in range(0, len(c), 4096):
                x = unit(matrix(c.slice(at, 4096), dim))
                out += x.T @ x
        return out

    _, vectors = np.linalg.eigh(summed(nodes.where(F.size("v") == dim).select("v"), work, (dim, dim)))
    return np.ascontiguousarray(vectors[:, ::-1])


class Strip:
    """Some nodes of one label: rotated unit vectors by tiles, with boxes and suffix norms."""

    def __init__(self, nodes: np.ndarray, counts: np.ndarray, given: np.ndarray, turn: np.ndarray | None):
        y = unit(given)
        if turn is not None and turn.shape[0] == y.shape[1]:
            y = y @ turn
        order = np.argsort(y[:, min(1, y.shape[1] - 1)], kind="stable")
        self.nodes, self.counts, self.given, self.y = nodes[order], counts[order], given[order], y[order]
        dim = y.shape[1]
        self.cuts = [*[s for s in STAGES if s < dim], dim]
        squares = np.cumsum((self.y * self.y)[:, ::-1], axis=1)[:, ::-1]
        self.suffix = [np.sqrt(squares[:, c]) if c < dim else np.zeros(len(y)) for c in self.cuts]
        self.tiles = [slice(a, min(a + TILE, len(y))) for a in range(0, len(y), TILE)]
        lead = self.y[:, : self.cuts[0]]
        self.low, self.high = (np.stack([f(lead[t], axis=0) for t in self.tiles]) for f in (np.min, np.max))


def tile_links(a: Strip, s: slice, b: Strip, t: slice, threshold: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of the linked pairs of two tiles; with ``upper`` each pair of one tile once."""
    least = threshold - SLACK
    rows, cols = np.arange(s.start, s.stop), np.arange(t.start, t.stop)
    acc, at = np.zeros((len(rows), len(cols))), 0
    pairs = None
    for k, to in enumerate(a.cuts):
        if pairs is None:
            acc += a.y[rows, at:to] @ b.y[cols, at:to].T
            alive = acc + np.outer(a.suffix[k][rows], b.suffix[k][cols]) >= least
            if upper:
                alive &= rows[:, None] < cols[None, :]
            n = np.count_nonzero(alive)
            if n * SPARSE < alive.size or to == a.y.shape[1]:
                i, j = np.nonzero(alive)
                pairs, acc = (rows[i], cols[j]), acc[i, j]
            else:
                i, j = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
                rows, cols, acc = rows[i], cols[j], acc[np.ix_(i, j)]
        else:
            i, j = pairs
            acc = acc + np.einsum("ij,ij->i", a.y[i, at:to], b.y[j, at:to])
            alive = acc + a.suffix[k][i] * b.suffix[k][j] >= least
            pairs, acc = (i[alive], j[alive]), acc[alive]
        if pairs is not None and not len(pairs[0]):
            return pairs
        at = to
    i, j = pairs
    hit = acc >= threshold
    near = np.flatnonzero(np.abs(acc - threshold) <= SLACK)
    if len(near):
        x, z = (v.astype(np.float64) for v in (a.given[i[near]], b.given[j[near]]))
        x, z = (v / np.abs(v).max(1, keepdims=True) for v in (x, z))
        hit[near] = (x * z).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((z * z).sum(1))) >= threshold
    return i[hit], j[hit]


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of i and j; ``parent`` holds the smallest position of each group, before and after."""
    while True:
        u, v = parent[i], parent[j]
        live = u != v
        if not live.any():
            return
        i, j = i[live], j[live]
        np.minimum.at(parent, np.maximum(u, v)[live], np.minimum(u, v)[live])
        while (parent != (up := parent[parent])).any():
            parent[:] = up


def strip_links(a: Strip, b: Strip | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, head) of the nodes that have links between two strips, or within one."""
    other = a if b is None else b
    shift = 0 if b is None else len(a.nodes)
    nodes = a.nodes if b is None else np.concatenate([a.nodes, b.nodes])
    links, parent = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
    reach = 2 - 2 * threshold + SLACK
    for p, s in enumerate(a.tiles):
        first = p if b is None else 0
        gap = np.maximum(np.maximum(other.low[first:] - a.high[p], a.low[p] - other.high[first:]), 0)
        for q in np.flatnonzero((gap * gap).sum(1) <= reach) + first:
            i, j = tile_links(a, s, other, other.tiles[q], threshold, b is None and p == q)
            if len(i):
                np.add.at(links, i, other.counts[j])
                np.add.at(links, j + shift, a.counts[i])
                unite(parent, i, j + shift)
    has = links > 0
    return nodes[has], links[has], nodes[parent[has]]


def strips(nodes: DataFrame, turn: np.ndarray | None, total: int, strip_bytes: int) -> DataFrame:
    """(label, dim, low, high, first, payload): the nodes of a label in runs by the leading coordinate."""
    shared = nodes.sparkSession.sparkContext.broadcast(turn)

    @F.arrow_udf("double")
    def leading(v: pa.Array) -> pa.Array:
        out = np.empty(len(v))
        dims = np.asarray(v.value_lengths())
        own = shared.value
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            for part in np.array_split(at, -(-len(at) // 4096)):
                x = unit(matrix(v.take(pa.array(part)), int(d)))
                out[part] = x @ own[:, 0] if own is not None and own.shape[0] == d else x[:, 0]
        return pa.array(out)

    def cut(batches):
        held, size, key = [], 0, None

        def close():
            t = pa.Table.from_batches(held)
            packed = pa.table({"nodes": t.column("node"), "counts": t.column("n"), "v": t.column("v")})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, packed.schema) as w:
                w.write_table(packed)
            c = t.column("c")
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([c[0].as_py()]), pa.array([c[len(c) - 1].as_py()]), pa.array([t.column("node")[0].as_py()]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["label", "dim", "low", "high", "first", "payload"],
            )

        for b in batches:
            labels, dims = b.column("label").to_pylist(), b.column("dim").to_pylist()
            at = 0
            while at < len(labels):
                if (own := (labels[at], dims[at])) != key or size >= strip_bytes:
                    if held:
                        yield close()
                    held, size, key = [], 0, own
                each = 8 * own[1] + 16
                to = at + 1
                while to < len(labels) and (labels[to], dims[to]) == own and size + (to - at) * each < strip_bytes:
                    to += 1
                held.append(b.slice(at, to - at))
                size += (to - at) * each
                at = to
        if held:
            yield close()

    keyed = nodes.select("label", F.size("v").alias("dim"), leading("v").alias("c"), "node", "n", "v")
    dealt = keyed.repartitionByRange(tasks_for(total), "label", "dim", "c", "node").sortWithinPartitions("label", "dim", "c", "node")
    return dealt.mapInArrow(released(cut), "label string, dim int, low double, high double, first long, payload binary")


def partners(table: DataFrame, reach: float) -> DataFrame:
    """(label, dim, i, j): numbers, i <= j, of the strips of a label whose leading coordinates lie within ``reach``."""
    own = table.select("label", "dim", "i", "low", "high")
    marks = own.select("label", "dim", F.col("low").alias("at"), F.lit(0).alias("query"), "i").union(own.select("label", "dim", F.col("high") + reach, F.lit(1), "i"))
    before = Window.partitionBy("label", "dim").orderBy("at", "query").rowsBetween(Window.unboundedPreceding, 0)
    last = marks.withColumn("last", F.sum(1 - F.col("query")).over(before)).where("query = 1")
    return last.select("label", "dim", "i", F.explode(F.sequence("i", "last")).alias("j"))


def near_vectors(df: DataFrame, *, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Links join vectors of one label whose cosine is ``threshold`` (above 0, at
    most 1) or more.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and not over 1")
    spark = df.sparkSession
    ws = Workspace(spark)
    v = F.transform(F.col("v"), lambda x: x + F.lit(0.0))  # one zero
    given = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fits = usable(F.col("v")) & F.col("label").isNotNull() & F.exists("v", lambda x: x != 0)
    key = F.sha2(F.to_json(F.struct("label", v.alias("v"))).cast("binary"), 256)
    given = given.withColumn("key", F.when(F.coalesce(fits, F.lit(False)), key))
    groups = given.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = ws.keep(groups.select(F.monotonically_increasing_id().alias("node"), "key", "least", "n", "label", "v"), "nodes")

    dim, n = common_length(nodes, "v")
    turn = rotation(nodes, dim)
    total = int(nodes.agg(F.sum(8 * F.size("v")).alias("b")).first()["b"] or 0)
    cut = ws.keep(strips(nodes, turn, total, strip_bytes), "strips")
    place = Window.partitionBy("label", "dim").orderBy("low", "first")
    numbered = cut.select("label", "dim", "low", "high", "first", F.row_number().over(place).cast("long").alias("i"))
    numbered = ws.keep(numbered, "numbers")
    pairs = partners(numbered, math.sqrt(2 - 2 * threshold) + SLACK)
    roles = pairs.withColumn("s", F.explode(F.array_distinct(F.array("i", "j"))))
    where = roles.join(numbered.select("label", "dim", F.col("i").alias("s"), "first"), ["label", "dim", "s"])
    sent = where.join(cut.select("first", "payload"), "first")
    shared = spark.sparkContext.broadcast(turn)

    def opened(blob: bytes, dim: int) -> Strip:
        t = pa.ipc.open_stream(blob).read_all()
        return Strip(t.column("nodes").to_numpy(), t.column("counts").to_numpy(), np.concatenate([matrix(c, dim) for c in t.column("v").chunks]), shared.value)

    def compare(t: pa.Table) -> pa.Table:
        have = dict(zip(t.column("s").to_pylist(), t.column("payload").to_pylist(), strict=True))
        i, j, dim = (t.column(c)[0].as_py() for c in ("i", "j", "dim"))
        node, links, head = strip_links(opened(have[i], dim), None if i == j else opened(have[j], dim), threshold)
        return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(links, pa.int64()), "head": pa.array(head, pa.int64())})

    found = sent.groupBy("label", "dim", "i", "j").applyInArrow(compare, "node long, links long, head long")
    found = ws.keep(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    part = connected_components(found.where("node <> head"), "node", "head")
    named = nodes.select("node", "key", "least", "n").join(links, "node", "left").join(part, "node", "left")
    named = ws.keep(named.select("key", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    hot = max(100, n // 2000)
    named = join_groups(named, ws.keep(least, "components"), ["component"], "size", hot).select("key", "n", "links", "component_id")
    rows = given.select("vec_id", "key")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rest = join_groups(rows.where("key is not null"), ws.keep(named, "classes"), ["key"], "n", hot)
    rest = rest.select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    return alone.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
