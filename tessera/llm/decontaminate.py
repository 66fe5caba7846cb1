"""Benchmark decontamination by latent semantic retrieval.

One pass over the documents keeps, of every word that some benchmark item
uses, its place and term: all that later passes need. From it come passage
frequencies over the whole corpus, TF-IDF vectors of overlapping passages
over the items' telling terms, and a randomised SVD: each task multiplies its
passages with a random test matrix (by the distinct pairs of terms that meet
in them, so copies cost nothing further) and sends one matrix of terms by
rank, summed by slices of rows; the driver orthonormalises it. Items are
weighted up in the decomposition, so that the space keeps what tells them
apart. Passages with a high cosine to an item in that space are candidates;
they are confirmed by the longest common subsequence of words around the place
where they align, or a shorter one together with the item's answer (an answer
column, else its last sentence).

An item longer than a passage asks by pieces of passage length. Items come in
blocks of at most ``item_block`` queries, and of fewer than the rank, so that
the space of a block has room for all of them; what the driver and the
broadcasts hold is bounded for any benchmark. The documents are read once for
all blocks whose words together number ``most_terms`` or fewer.

Definite results: null or empty text is clean; null or wordless items match
nothing; items that repeat match alike, and the smallest item_id is named; a
null item_id matches too and is named by null; a null doc_id is an ordinary
row, and rows with one doc_id are judged each; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.runtime import Workspace

_TO_SPACE = bytes(i if (48 <= i <= 57 or 97 <= i <= 122 or i >= 128) else 32 for i in range(256))
FOUND = "contaminated boolean, item_id long, lcs double, cosine double"


def plain(text: str | None) -> bytes:
    """Lower case, with everything but letters and digits as spaces."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel in ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass(frozen=True)
class Item:
    """A benchmark item as word hashes."""

    id: int | None
    words: np.ndarray
    answer: tuple[int, int]  # words [from, to) of the answer

    @staticmethod
    def read(item: int | None, text: str, answer: str | None) -> Item | None:
        words = B.Words([plain(text)]).hashes(0)
        if not len(words):
            return None
        if answer and len(tail := B.Words([plain(answer)]).hashes(0)):
            words = np.concatenate([words, tail])
            return Item(item, words, (len(words) - len(tail), len(words)))
        parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if plain(p).strip()]
        n_tail = len(B.Words([plain(parts[-1])]).start) if len(parts) > 1 else 0
        return Item(item, words, (len(words) - n_tail, len(words)))

    def queries(self, width: int) -> list[tuple[int, int]]:
        """Words [from, to) of the pieces that are searched for: one, or several of ``width`` words."""
        n = len(self.words)
        if n <= width + width // 2:
            return [(0, n)]
        return [(a, a + width) for a in [*range(0, n - width, width // 2), n - width]]


@dataclass(frozen=True)
class Block:
    """Items that share a latent space, as terms of their own vocabulary."""

    ids: list[int | None]
    terms: list[np.ndarray]  # term of each word
    answer: list[tuple[int, int]]
    vocab: np.ndarray  # sorted word hashes; the place is the term
    query: list[tuple[int, int, int]]  # item and its words [from, to)

    @staticmethod
    def build(items: list[Item], width: int) -> Block:
        vocab = np.unique(np.concatenate([i.words for i in items]))
        query = [(k, a, b) for k, i in enumerate(items) for a, b in i.queries(width)]
        return Block([i.id for i in items], [np.searchsorted(vocab, i.words) for i in items], [i.answer for i in items], vocab, query)

    def own(self, union: np.ndarray) -> np.ndarray:
        """The block's term for each term of ``union``, or -1."""
        out = np.full(len(union), -1, dtype=np.int32)
        out[np.searchsorted(union, self.vocab)] = np.arange(len(self.vocab), dtype=np.int32)
        return out


@dataclass(frozen=True)
class Space:
    """Term weights, and what a term adds to the product of a passage with each query in the latent space."""

    weight: np.ndarray  # 0 for terms that tell nothing
    adds: np.ndarray  # terms x queries
    most: np.ndarray  # greatest of a term's row


def _sequences(docs: DataFrame, vocab: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_words, found): places and terms (int32 pairs) of the words that items use."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # ``most_terms`` hashes at most, and one item's more

    def run(batches):
        vocab = shared.value
        for b in (part for whole in batches for part in B.by_bytes(whole, 2)):
            w = B.Words([plain(t) for t in b.column(2).to_pylist()])
            h = w.hashes(0)
            at = np.searchsorted(vocab, h)
            at[at == len(vocab)] = 0
            hit = np.flatnonzero(vocab[at] == h)
            pairs = np.empty((len(hit), 2), dtype=np.int32)
            pairs[:, 0] = hit - w.first[w.doc[hit]]
            pairs[:, 1] = at[hit]
            ends = np.concatenate([[0], np.cumsum(np.bincount(w.doc[hit], minlength=b.num_rows))]) * 8
            found = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(pairs)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w.count), found.cast(pa.binary())], ["row", "doc_id", "n_words", "found"])

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(B.released(run), "row long, doc_id long, n_words long, found binary")


class _Part:
    """The words of some documents that a block's items use."""

    def __init__(self, batch: pa.RecordBatch, own: np.ndarray, width: int):
        found = batch.column("found").cast(pa.large_binary())
        _, offsets, data = found.buffers()
        cut = np.frombuffer(offsets, dtype=np.int64)[found.offset : found.offset + len(found) + 1] // 8
        pairs = np.frombuffer(data, dtype=np.int32).reshape(-1, 2)[cut[0] : cut[-1]] if data is not None and cut[-1] else np.empty((0, 2), np.int32)
        term = own[pairs[:, 1]]
        mine = np.flatnonzero(term >= 0)
        row = np.repeat(np.arange(len(found)), np.diff(cut))[mine]
        self.place, self.term = pairs[mine, 0].astype(np.int64), term[mine].astype(np.int64)
        self.cut = np.searchsorted(row, np.arange(len(found) + 1))
        n = -(-np.maximum(np.asarray(batch.column("n_words"), dtype=np.int64), 1) // (width // 2))
        self.base = np.cumsum(n) - n  # first passage of each document
        self.half = self.place // (width // 2)
        self.passage = self.base[row] + self.half

    def halves(self, v: int) -> np.ndarray:
        """Term of every distinct (half passage, term): what frequencies count."""
        return np.unique(self.passage * v + self.term) % v

    def passages(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (passage, term) of kept terms, in order. Passages overlap by half."""
        own = np.flatnonzero(keep[self.term])
        passage, term = self.passage[own], self.term[own]
        ok = self.half[own] > 0
        key = np.unique(np.concatenate([passage, passage[ok] - 1]) * len(keep) + np.concatenate([term, term[ok]]))
        return key // len(keep), key % len(keep)


def _groups(passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of one passage."""
    start = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else np.empty(0, np.int64)
    return start, np.diff(np.append(start, len(passage)))


def _sum_arrays(df: DataFrame, local: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, ...], slice_rows: int = 512) -> np.ndarray:
    """Sum of one array a task, added up by slices of rows before anything reaches the driver."""
    kind = np.float32 if len(shape) > 1 else np.float64

    def send(batches):
        total = local(part for whole in batches for part in B.by_bytes(whole, "found", 4 << 20))
        starts = range(0, shape[0], slice_rows)
        yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int64()), pa.array([total[s : s + slice_rows].astype(kind).tobytes() for s in starts], pa.binary())], ["slice", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = 0
        for blob in t.column("part"):
            total = total + np.frombuffer(blob.as_buffer(), dtype=kind).astype(np.float64)
        return pa.table({"slice": t.column("slice").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    parts = df.mapInArrow(B.released(send), "slice long, part binary").groupBy("slice").applyInArrow(add, "slice long, part binary").collect()  # one array of that shape in all
    out = np.zeros(shape)
    for r in parts:
        x = np.frombuffer(r["part"], dtype=np.float64).reshape(-1, *shape[1:])
        out[r["slice"] : r["slice"] + len(x)] = x
    return out


def _pairs(start: np.ndarray, size: np.ndarray, term: np.ndarray, v: int) -> np.ndarray:
    """Every two terms that meet in a passage, as lesser * v + greater."""
    later = np.repeat(start + size, size) - np.arange(len(term)) - 1  # terms after each one in its passage
    return np.repeat(term, later) * v + term[B.ragged(np.arange(len(term)) + 1, later)]


def _counted(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, weights=np.concatenate(times), minlength=len(key))


def _apply_pairs(key: np.ndarray, value: np.ndarray, basis: np.ndarray, out: np.ndarray) -> None:
    """Add the symmetric matrix of the pairs, times ``basis``, to ``out``."""
    v = len(basis)
    for row, col in ((key // v, key % v), (key % v, key // v)):
        order = np.argsort(row, kind="stable")
        for at in range(0, len(order), 50_000):
            o = order[at : at + 50_000]
            head = np.flatnonzero(np.concatenate([[True], row[o][1:] != row[o][:-1]]))
            out[row[o][head]] += np.add.reduceat(basis[col[o]] * value[o, None].astype(np.float32), head, axis=0)


def _space(seqs: DataFrame, block: Block, own, width: int, rank: int, common: float, telling: int, rounds: int) -> Space:
    spark = seqs.sparkSession
    v = len(block.vocab)
    n_passages = int(seqs.agg(F.sum(F.ceil(F.greatest(F.col("n_words"), F.lit(1)) / (width // 2)))).first()[0] or 1)

    def frequencies(parts):
        out = np.zeros(v)
        for b in parts:
            out += np.bincount(_Part(b, own.value, width).halves(v), minlength=v)
        return out

    df = _sum_arrays(seqs, frequencies, (v,))
    idf = np.log((1 + n_passages) / (1 + df)) + 0.1
    keep = df <= common * n_passages
    for k, a, b in block.query:  # a query of frequent words keeps its rarest ones, so that copies cannot hide it
        terms = np.unique(block.terms[k][a:b])
        keep[terms[np.argsort(df[terms], kind="stable")[:telling]]] = True
    weight = np.where(keep, idf, 0.0)
    a = np.zeros((len(block.query), v))
    for i, (k, x, y) in enumerate(block.query):
        a[i, block.terms[k][x:y]] = weight[block.terms[k][x:y]]
    r = min(rank, len(block.query) + 16, v)
    rng = np.random.Generator(np.random.PCG64(23))
    basis = np.linalg.qr(rng.normal(size=(v, r)))[0]
    scale = 10 * max(1.0, n_passages / max(1, len(block.query)))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((weight, basis.astype(np.float32)))  # a block's terms by rank: bounded

        def times(parts):
            weight, basis = shared.value
            diagonal, keys, counts, held = np.zeros(v), [], [], 0
            for b in parts:
                passage, term = _Part(b, own.value, width).passages(weight > 0)
                diagonal += np.bincount(term, minlength=v)
                key, n = np.unique(_pairs(*_groups(passage), term, v), return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > 4_000_000:
                    key, n = _counted(keys, counts)
                    keys, counts, held = [key], [n], 0
            out = (diagonal * weight**2)[:, None] * basis
            if keys:
                key, n = _counted(keys, counts)
                _apply_pairs(key, n * weight[key // v] * weight[key % v], basis, out)
            return out

        y = _sum_arrays(seqs, times, (v, r)) + scale * (a.T @ (a @ basis))
        basis = np.linalg.qr(y)[0]
        shared.unpersist()
    z = a @ basis
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    z = np.divide(z, norm, out=np.zeros_like(z), where=norm > 1e-9)
    adds = ((weight[:, None] * basis) @ z.T).astype(np.float32)
    return Space(weight, adds, adds.max(1, initial=0.0))


def _confirm(item: np.ndarray, answer: tuple[int, int], place: np.ndarray, term: np.ndarray, lo: int, hi: int, telling: np.ndarray) -> tuple[float, bool]:
    """Share of the item's words in the longest common subsequence near the best alignment, and whether that is contamination."""
    n = len(item)
    x, y = np.searchsorted(place, [lo - n, hi + n])
    p, t = place[x:y], term[x:y]
    first: dict[int, list[int]] = {}
    for j, k in enumerate(item.tolist()):
        first.setdefault(k, []).append(j)
    votes: dict[int, int] = {}
    for q, k in zip(p.tolist(), t.tolist(), strict=True):
        if telling[k] > 0:
            for j in first.get(k, ()):
                votes[q - j] = votes.get(q - j, 0) + 1
    if not votes:
        return 0.0, False
    near = 1 + n // 8
    shift = max(votes, key=lambda s: (sum(c for d, c in votes.items() if abs(d - s) <= near), votes[s], -s))
    slack = 2 + n // 4
    u, w = np.searchsorted(p, [shift - slack, shift + n + slack])
    own = t[u:w].tolist()
    share = lcs(item.tolist(), own) / n
    if n < 8:
        return share, share == 1.0
    if share >= 0.75:
        return share, True
    a, b = answer
    tail = item[a:b].tolist()
    return share, share >= 0.6 and len(tail) >= 3 and lcs(tail, own) >= 0.9 * len(tail)


def _candidates(part: _Part, space: Space, cosine: float) -> Iterator[tuple[int, int, float]]:
    """(passage, query, cosine) of at least ``cosine``."""
    passage, term = part.passages(space.weight > 0)
    if not len(passage):
        return
    start, size = _groups(passage)
    length = np.sqrt(np.add.reduceat(space.weight[term] ** 2, start))
    go = np.add.reduceat(space.most[term], start) >= cosine * length - 1e-6  # no query can reach it otherwise
    start, size, length = start[go], size[go], length[go]
    step = max(1, 4_000_000 // (space.adds.shape[1] * max(1, int(size.max(initial=1)))))
    for at in range(0, len(start), step):
        n = size[at : at + step]
        c = np.add.reduceat(space.adds[term[B.ragged(start[at : at + step], n)]], np.cumsum(n) - n, axis=0) / length[at : at + step, None]
        for i, j in zip(*np.nonzero(c >= cosine), strict=True):
            yield int(passage[start[at + i]]), int(j), float(c[i, j])


def _search(seqs: DataFrame, block: Block, own, space: Space, width: int, cosine: float, only_found: bool) -> DataFrame:
    """The best match of every document, or of those alone that have a candidate."""
    shared = seqs.sparkSession.sparkContext.broadcast((block, space))  # one block of items: bounded

    def run(batches):
        block, space = shared.value
        half = width // 2
        for b in (part for whole in batches for part in B.by_bytes(whole, "found")):
            part = _Part(b, own.value, width)
            best: dict[int, tuple] = {}
            for passage, j, c in _candidates(part, space, cosine):
                r = int(np.searchsorted(part.base, passage, side="right")) - 1
                x, y = part.cut[r : r + 2]
                k, lo = block.query[j][0], (passage - int(part.base[r])) * half
                share, bad = _confirm(block.terms[k], block.answer[k], part.place[x:y], part.term[x:y], lo, lo + width, space.weight)
                item = block.ids[k]
                new = (bad, share, c, item is not None, -(item or 0))
                if r not in best or new > best[r]:
                    best[r] = new
            if only_found:
                b = b.take(pa.array(sorted(best), pa.int64()))
                got = [best[i] for i in sorted(best)]
            else:
                got = [best.get(i) for i in range(b.num_rows)]
            found = [pa.array([bool(g and g[0]) for g in got], pa.bool_()), pa.array([-g[4] if g and g[3] else None for g in got], pa.int64()), pa.array([g[1] if g else 0.0 for g in got], pa.float64()), pa.array([g[2] if g else 0.0 for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *found], ["row", "doc_id", "contaminated", "item_id", "lcs", "cosine"])

    return seqs.mapInArrow(B.released(run), f"row long, doc_id long, {FOUND}")


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, answer_col: str | None, width: int, most: int) -> Iterator[Block]:
    """Items in order of id, in blocks of at most ``most`` queries (an item of more is alone)."""
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), answer.alias("a"))
    held, n = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        item = Item.read(r["i"], r["t"], r["a"])
        if item is None:
            continue
        k = len(item.queries(width))
        if held and n + k > most:
            yield Block.build(held, width)
            held, n = [], 0
        held.append(item)
        n += k
    if held:
        yield Block.build(held, width)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, width: int = 32, cosine: float = 0.45, rank: int = 512, common: float = 0.002, telling: int = 8, rounds: int = 1, item_block: int = 2000, most_terms: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, contaminated, item_id (the best match, null if no candidate), lcs, cosine."""
    ws = Workspace(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    out: list[DataFrame] = []

    def finish(held: list[Block], union: np.ndarray) -> None:
        seqs = ws.keep(_sequences(docs, union, id_col, text_col), "sequences")
        for i, block in enumerate(held):
            own = sc.broadcast(block.own(union))
            space = _space(seqs, block, own, width, max(rank, len(block.query) + 16), common, telling, rounds)
            out.append(_search(seqs, block, own, space, width, cosine, only_found=i > 0))

    held, union = [], np.empty(0, np.uint64)
    for block in _item_blocks(benchmark, item_col, item_text_col, answer_col, width, max(1, min(item_block, rank - 16))):
        if held and len(union) + len(block.vocab) > most_terms:
            finish(held, union)
            held, union = [], np.empty(0, np.uint64)
        held.append(block)
        union = np.union1d(union, block.vocab)
    if held:
        finish(held, union)
    if not out:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(False).alias("contaminated"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("lcs"), F.lit(0.0).alias("cosine"))
    if len(out) == 1:
        return out[0].drop("row")
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    top = F.max_by(F.struct("doc_id", "contaminated", "item_id", "lcs", "cosine"), F.struct("contaminated", "lcs", "cosine", -F.col("item_id")))
    return every.groupBy("row").agg(top.alias("b")).select("b.*")
