"""Alignment of two tokenizers over a corpus.

A document's tokens of both vocabularies are runs of the same bytes. A link is
a pair of token occurrences whose byte ranges overlap; every stretch between
neighbouring token borders of either side is one link. Borders that both sides
share cut the tokens into groups.

1. Documents are tokenised once, where they lie; the ids are written in slices.
2. Every partition counts, by ``np.unique`` over packed pair keys (id of A in
   the high half of an int64, id of B in the low half), how many documents hold
   a linked pair.
3. The partial counts are range-partitioned by key and sorted; equal keys are
   neighbours, and run-length sums give the counts of the corpus. Each range
   is a shard of two sorted arrays in the shared folder.
4. The documents' links look their counts up by ``searchsorted`` in the
   memory-mapped shards: no task holds the table, and pages that are read
   stay in the file cache of a machine. The best count of every id of A, at
   most one number an id of the vocabulary, is broadcast.

Where the shared folder is not mounted (its scheme is not ``file``), the
counts are a written table there, which every machine fetches through Spark
(``addFile``) and maps.

Definite results: a null, empty or undecodable text, and one whose joined
tokens of either side are not its bytes, has no tokens: zeros and an empty
hash; repeated rows, and rows without an id, are documents of their own; long
texts are tokenised whole; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import arrays, by_bytes, released, texts_of, unpack
from tessera.runtime import Workspace, importable, tasks_for

#: The pattern of byte-level pre-tokens; fixed value of that tokenizer kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HELD = 1 << 21  # keys that a counting task holds before it sums them
SLICE = 1 << 20  # bytes of text in a written slice
CHUNK = 1 << 19  # tokens whose ids are spelled at a time


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1 ... of every run, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(lengths.sum())) + np.repeat(starts - (ends - lengths), lengths)


class Vocabulary:
    """The bytes of every token: ``lengths`` and ``data`` (one after another)."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return self.data[ragged(self.starts[ids], self.lengths[ids])].tobytes()


class ByteVocabulary(Vocabulary):
    """A byte-level vocabulary file.

    Where the file's merges are in the order of their ids, and it splits by
    the usual pattern without a normaliser, ranks give the same ids several
    times faster, and joined tokens are the text's bytes by construction; any
    other file goes through its own library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab, special = told["model"]["vocab"], {t["content"] for t in told["added_tokens"]}
        tokens = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in told["added_tokens"])]))
        for t, i in vocab.items():
            tokens[i] = t.encode() if t in special else bytes(letters[c] for c in t)
        super().__init__(tokens)
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        split = {k: told["pre_tokenizer"].get(k) for k in ("type", "add_prefix_space", "use_regex")}
        usual = split == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and told["normalizer"] is None and told["post_processor"] is None
        model = told["model"]
        usual &= not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.lossless = usual and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges)) and all(vocab[x] < 256 for x in letters)
        if self.lossless:
            import tiktoken

            ranks = {tokens[i]: i for t, i in vocab.items() if t not in special}
            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [own.encode_to_numpy(t, disallowed_special=()) for t in texts]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self.encode = lambda texts: [np.array(x.ids, dtype=np.uint32) for x in own.encode_batch(texts, add_special_tokens=False)]

    def aligned(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of a space and each text; none where they do not give its bytes."""
        ids = self.encode([" " + t for t in texts])
        return ids if self.lossless else [x if self.bytes_of(x) == b" " + t.encode() else None for x, t in zip(ids, texts, strict=True)]


class PieceVocabulary(Vocabulary):
    """A piece model that puts a space before a text.

    Where no piece reaches from one word into the next, a text's ids are its
    words' ids one after another, and a word met before (``most`` words are
    kept) costs a look-up; texts with spaces side by side or at an end, or
    the space sign itself, go whole.
    """

    SIGN = "▁"

    def __init__(self, path: str, most: int = 100_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(self.SIGN, " ").encode() for i, p in enumerate(pieces)])
        self.by_word = not any(self.SIGN in p.lstrip(self.SIGN) for p in pieces)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.first = np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.whole = np.empty(0, dtype=bool)

    def learn(self, words: list[str]) -> None:
        got = self.model.encode(words, num_threads=1)
        n = np.array([len(x) for x in got], dtype=np.int64)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum()))])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n)])
        ends = np.cumsum(self.lengths[self.ids[len(self.ids) - int(n.sum()) :]])
        same = b"".join(b" " + w.encode() for w in words)
        if self.bytes_of(self.ids[len(self.ids) - int(n.sum()) :]) == same and np.array_equal(np.concatenate([[0], ends])[np.cumsum(n)], np.cumsum([1 + len(w.encode()) for w in words])):
            fits = np.ones(len(words), dtype=bool)
        else:
            fits = np.array([self.bytes_of(np.array(x, dtype=np.int64)) == b" " + w.encode() for x, w in zip(got, words, strict=True)])
        self.whole = np.concatenate([self.whole, fits])

    def aligned(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text; none where they do not give a space and its bytes."""
        simple = [self.by_word and t != "" and "  " not in t and t[0] != " " and t[-1] != " " and self.SIGN not in t for t in texts]
        split = [t.split(" ") if ok else [] for t, ok in zip(texts, simple, strict=True)]
        new = list({w: None for own in split for w in own if w not in self.number})
        if len(new) + len(self.number) > self.most:
            self.clear()
            new = list({w: None for own in split for w in own})
        if new:
            self.number |= dict(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.learn(new)
        number = self.number
        out: list[np.ndarray | None] = []
        for t, ok, own in zip(texts, simple, split, strict=True):
            if ok:
                at = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
                ids, sure = self.ids[ragged(self.first[at], self.first[at + 1] - self.first[at])], self.whole[at].all()
            else:
                ids, sure = np.array(self.model.encode(t), dtype=np.uint32), False
            out.append(ids if sure or self.bytes_of(ids) == b" " + t.encode() else None)
        return out


@cache
def byte_vocabulary(path: str) -> ByteVocabulary:
    return ByteVocabulary(path)


@cache
def piece_vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)


def tokenise(texts: list[bytes], a: ByteVocabulary, b: PieceVocabulary) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of both sides; none where a text cannot be aligned."""
    none = np.empty(0, dtype=np.uint32)
    out_a, out_b, at, plain = [none] * len(texts), [none] * len(texts), [], []
    for i, t in enumerate(texts):
        try:
            if t:
                plain.append(t.decode())
                at.append(i)
        except UnicodeDecodeError:
            pass
    for i, x, y in zip(at, a.aligned(plain), b.aligned(plain), strict=True):
        if x is not None and y is not None:
            out_a[i], out_b[i] = x, y
    return out_a, out_b


class Slice:
    """Links and groups of the documents of one slice."""

    def __init__(self, blob: bytes, a: Vocabulary, b: Vocabulary):
        self.docs, missing, self.n_a, self.n_b, ids_a, ids_b = unpack(blob, np.int64, np.uint8, np.int64, np.int64, np.int32, np.int32)
        self.missing = missing.astype(bool)
        self.a, self.b = ids_a.astype(np.int64), ids_b.astype(np.int64)
        ends_a, ends_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        both = np.concatenate([ends_a, ends_b])
        both.sort(kind="stable")
        new = np.ones(len(both), dtype=bool)
        new[1:] = both[1:] != both[:-1]
        ends = both[new]
        self.at_a, self.at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)  # token of each side that a link belongs to
        self.keys = self.a[self.at_a] << 32 | self.b[self.at_b]
        self.shared = ends_b[np.clip(np.searchsorted(ends_b, ends_a), 0, max(0, len(ends_b) - 1))] == ends_a if len(ends_a) else np.zeros(0, dtype=bool)
        self.last_a = np.flatnonzero(self.shared)  # last token of A in each group
        self.last_b = np.searchsorted(ends_b, ends_a[self.last_a])
        first = np.cumsum(self.n_a)
        self.doc_of_a = np.repeat(np.arange(len(self.docs)), self.n_a)
        self.doc = self.doc_of_a[self.at_a]
        self.groups = np.bincount(self.doc_of_a[self.last_a], minlength=len(self.docs)) if len(first) else np.zeros(0, dtype=np.int64)

    def document_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and how many documents hold each."""
        keys, where = np.unique(self.keys, return_inverse=True)
        pairs = np.unique(self.doc * np.int64(len(keys)) + where)
        return keys, np.bincount(pairs % max(1, len(keys)), minlength=len(keys)).astype(np.int64)

    @cached_property
    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids in the order in which they are spelled, and the mark after each (1: comma, 2: bar, 3: semicolon)."""
        size_a = np.diff(self.last_a, prepend=-1)
        size_b = np.diff(self.last_b, prepend=-1)
        start_a = np.cumsum(size_a + size_b) - size_a - size_b
        at_a = np.arange(len(self.a)) + np.repeat(start_a - (np.cumsum(size_a) - size_a), size_a)
        at_b = np.arange(len(self.b)) + np.repeat(start_a + size_a - (np.cumsum(size_b) - size_b), size_b)
        ids, marks = np.empty(len(at_a) + len(at_b), dtype=np.int64), np.ones(len(at_a) + len(at_b), dtype=np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        marks[at_a[self.last_a]], marks[at_b[self.last_b]] = 2, 3
        return ids, marks

    def hashes(self, spell: Speller) -> list[str]:
        ids, marks = self.order
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            h = hashlib.sha256()
            for k in range(at, at + n, CHUNK):
                to = min(k + CHUNK, at + n)
                said = spell(ids[k:to], marks[k:to])
                h.update(said if to < at + n else said[:-1])
            out.append(h.hexdigest() if n else "")
            at += n
        return out


class Speller:
    """Decimal ids, each with a mark after it."""

    def __init__(self, most: int):
        width = len(str(most))
        n = np.arange(most + 1)
        self.digits = np.stack([n // 10**k % 10 + 48 for k in range(width - 1, -1, -1)] + [n * 0], axis=1).astype(np.uint8)
        self.shown = np.concatenate([n[:, None] >= 10 ** np.arange(width - 1, -1, -1)[None, :], np.ones((most + 1, 1), dtype=bool)], axis=1)
        self.shown[0, -2] = True

    def __call__(self, ids: np.ndarray, marks: np.ndarray) -> bytes:
        out = self.digits[ids]
        out[:, -1] = np.frombuffer(b"\0,|;", dtype=np.uint8)[marks]
        return out[self.shown[ids]].tobytes()


def summed_runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each once, with the sum of its counts."""
    if not len(keys):
        return keys, counts
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(counts, new)


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    return summed_runs(keys[order], counts[order])


def sliced(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        a, b = byte_vocabulary(path_a), piece_vocabulary(path_b)
        for whole in batches:
            for part in by_bytes(whole, 1, SLICE):
                x, y = tokenise(texts_of(part.column(1)), a, b)
                ids = part.column(0)
                flat = [np.concatenate(side).astype(np.int32) for side in (x, y)]
                sizes = [np.array([len(t) for t in side], dtype=np.int64) for side in (x, y)]
                missing = np.asarray(ids.is_null()).astype(np.uint8)
                blob = arrays(np.asarray(ids.fill_null(0), dtype=np.int64), missing, *sizes, *flat)
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["slice"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(released(run), "slice binary")


def partial_counts(slices: DataFrame, path_a: str, path_b: str, held_keys: int = HELD) -> DataFrame:
    def batch(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    def run(batches):
        a, b = byte_vocabulary(path_a), piece_vocabulary(path_b)
        held, n = [], 0
        for blob in (x for t in batches for x in t.column(0).to_pylist()):
            held.append(Slice(blob, a, b).document_counts())
            n += len(held[-1][0])
            if n > held_keys:
                held = [merged(held)]
                n = len(held[0][0])
                if 2 * n > held_keys:
                    yield batch(*held[0])
                    held, n = [], 0
        if held:
            yield batch(*merged(held))

    return slices.mapInArrow(released(run), "key long, n long")


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of the runs of equal keys in a sorted stream; the last run waits for the next batch."""
    last: tuple[np.ndarray, np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        have = (np.asarray(b.column(0)), np.asarray(b.column(1)))
        keys, counts = summed_runs(*(np.concatenate(x) for x in zip(*([last] if last else []), have, strict=True)))
        yield keys[:-1], counts[:-1]
        last = (keys[-1:], counts[-1:])
    if last:
        yield last


def best_of(keys: np.ndarray, counts: np.ndarray, best: dict[int, int]) -> None:
    if len(keys):
        ids = keys >> 32
        new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        for i, n in zip(ids[new].tolist(), np.maximum.reduceat(counts, new).tolist(), strict=True):
            best[i] = max(best.get(i, 0), n)


class Counts:
    """Sorted count shards, mapped when first asked."""

    def __init__(self, folder: str, fetched: bool):
        self.folder, self.fetched, self.maps = folder, fetched, None

    def __getstate__(self):
        return {"folder": self.folder, "fetched": self.fetched, "maps": None}

    def open(self) -> None:
        if self.fetched:
            folder = SparkFiles.get(self.folder)
            for path in glob.glob(f"{folder}/*.parquet"):
                if not os.path.exists(f"{path}.n"):
                    t = pq.read_table(path)
                    for name, column in (("keys", "key"), ("n", "n")):  # the file that is looked for comes last
                        _write(f"{path}.{name}", [np.asarray(t.column(column))])
        else:
            folder = self.folder
        names = sorted(x[:-5] for x in glob.glob(f"{folder}/*.keys") if os.path.getsize(x))
        maps = [(np.memmap(f"{x}.keys", np.int64, "r"), np.memmap(f"{x}.n", np.int64, "r")) for x in names]
        maps.sort(key=lambda m: m[0][0])
        self.maps = maps
        self.first = np.array([m[0][0] for m in maps], dtype=np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, all of which are there."""
        out = np.empty(len(keys), dtype=np.int64)
        if not len(keys):
            return out
        if self.maps is None:
            self.open()
        cuts = [0, *np.searchsorted(keys, self.first[1:]), len(keys)]
        for (have, n), x, y in zip(self.maps, cuts[:-1], cuts[1:], strict=True):
            if y > x:
                out[x:y] = n[np.searchsorted(have, keys[x:y])]
        return out


def _write(path: str, parts: list[np.ndarray]) -> None:
    """A whole file or none: a task that runs twice replaces it by the same bytes."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        for x in parts:
            f.write(np.ascontiguousarray(x, dtype=np.int64).tobytes())
    os.replace(own, path)


def count_shards(ws: Workspace, partial: DataFrame) -> tuple[Counts, dict[int, int]]:
    """The corpus's counts by key, and the best count of each id of A."""
    spark = ws.spark
    size = partial.count() * 16
    dealt = partial.repartitionByRange(tasks_for(size, 64 << 20), "key").sortWithinPartitions("key")
    place = urlparse(ws.root)
    if place.scheme not in ("", "file"):
        table = ws.keep(dealt.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"]) for k, n in run_lengths(batches)), "key long, n long"), "counts")
        spark.sparkContext.addFile(table._tessera_path, recursive=True)
        best = {r["a"]: r["n"] for r in table.groupBy(F.shiftright("key", 32).cast("int").alias("a")).agg(F.max("n").alias("n")).collect()}
        return Counts(os.path.basename(table._tessera_path), True), best
    folder = f"{place.path}/shards"

    def shard(batches):
        os.makedirs(folder, exist_ok=True)
        name, own = f"{folder}/{TaskContext.get().partitionId():06d}", uuid.uuid4().hex
        best: dict[int, int] = {}
        with open(f"{name}.keys.{own}", "wb") as f, open(f"{name}.n.{own}", "wb") as g:
            for keys, counts in run_lengths(batches):
                f.write(keys.tobytes())
                g.write(counts.tobytes())
                best_of(keys, counts, best)
        os.replace(f"{name}.n.{own}", f"{name}.n")
        os.replace(f"{name}.keys.{own}", f"{name}.keys")
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], ["a", "n"])

    # at most one row an id of the vocabulary and two more a shard
    rows = dealt.mapInArrow(shard, "a long, n long").collect()
    best: dict[int, int] = {}
    for r in rows:
        best[r["a"]] = max(best.get(r["a"], 0), r["n"])
    return Counts(folder, False), best


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` is a byte-level vocabulary file, ``path_b`` a piece model, both
    at the same path on every machine.
    """
    spark = importable(docs.sparkSession)
    ws = Workspace(spark)
    slices = ws.keep(sliced(docs, path_a, path_b, id_col, text_col), "slices")
    counts, best = count_shards(ws, ws.keep(partial_counts(slices, path_a, path_b), "partial"))
    top = np.zeros(max([*best, 0]) + 1, dtype=np.int64)
    top[list(best)] = list(best.values())
    shared = spark.sparkContext.broadcast((counts, top))

    def run(batches):
        a, b = byte_vocabulary(path_a), piece_vocabulary(path_b)
        spell = Speller(max(len(a.lengths), len(b.lengths)) - 1)
        counts, top = shared.value
        for blob in (x for t in batches for x in t.column(0).to_pylist()):
            s = Slice(blob, a, b)
            keys, where = np.unique(s.keys, return_inverse=True)
            n = counts.of(keys)
            is_best = n == top[keys >> 32]
            total = np.zeros(len(s.docs), dtype=np.int64)
            np.add.at(total, s.doc, n[where])
            per = lambda m, s=s: np.bincount(s.doc[m], minlength=len(s.docs))
            cols = [pa.array(s.docs, pa.int64(), mask=s.missing), *(pa.array(x, pa.int64()) for x in (s.n_a, s.n_b, s.groups, per(slice(None)), per(is_best[where]), total)), pa.array(s.hashes(spell), pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [c.split(" ")[0] for c in SCHEMA.split(", ")])

    return slices.mapInArrow(released(run), SCHEMA)
