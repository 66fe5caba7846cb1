"""Packing of tokenised documents into sequences of a fixed length.

Documents are tokenised where they lie and cut into full pieces and a rest.
Documents are dealt at random, by row, to groups, and each group is packed on
its own by first-fit decreasing: a tournament tree over the free room of the
bins gives the first bin that holds the next piece in logarithmic time. Groups
are large enough (about ``group_pieces``) that their last, open bins weigh
little, and small enough for one task.

Definite results: null text is empty and is one piece, the closing id; rows
with one doc_id, or none, are documents of their own; an empty table gives no
pieces; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm.blocks import Words, ragged, slices, texts_of
from tessera.runtime import Workspace


#: A word of Latin letters that normalisation only lower-cases, and closing marks: two pre-tokens at most.
_WORD = re.compile("([A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)([.,;:!?]*)")


#: What the chunk cache relies on, as tokenizer files state it; a file that differs is used on whole texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

_BLANKS = bytes(32 if 9 <= i <= 13 else i for i in range(256))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkTokenizer:
    """Token ids of whole texts, by a cache over runs of non-space bytes.

    For a byte-level tokenizer whose pre-tokens never cross ASCII white space
    (which it drops) and are runs of letters or of marks, lower-cased: a
    text's ids are its chunks' ids one after another, and a chunk of letters
    and closing marks has the ids of the two. A chunk met before costs a
    dictionary look-up, a new one with a known word little more; every other
    chunk goes through the tokenizer whole. The caches hold at most ``most``
    chunks (about 40 MB) and ``most_words`` words (about 20 MB).
    """

    def __init__(self, path: str, most: int = 250_000, most_words: int = 60_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.by_chunk = told.get("normalizer") == NORMALIZER and told.get("pre_tokenizer") == PRE_TOKENIZER and told.get("post_processor") is None and told["model"]["type"] == "BPE"
        del told
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most_words = most_words
        self.letters = _byte_letters()
        self.most = most
        self.words: dict[str, list[int]] = {"": []}
        self.clear()

    def clear(self) -> None:
        """Forget all chunks (known words stay)."""
        self.place: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.start = np.empty(1 << 16, dtype=np.int64)
        self.size = np.empty(1 << 16, dtype=np.int64)
        self.used = 0

    def _pre_token(self, s: str) -> list[int]:
        got = self.words.get(s)
        if got is None:
            if len(self.words) > self.most_words:
                self.words = {"": []}
            shown = s if s.isascii() else "".join([self.letters[b] for b in s.encode()])
            got = self.words[s] = [t.id for t in self.model.tokenize(shown)]
        return got

    def _add(self, chunks: list[bytes]) -> None:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            got: list = [None] * len(part)
            other: list[int] = []
            texts = [c.decode() for c in part]
            for i, c in enumerate(texts):
                if m := _WORD.fullmatch(c):
                    word, marks = m.groups()
                    ids = self._pre_token(word.lower())
                    got[i] = ids + self._pre_token(marks) if marks else ids
                else:
                    other.append(i)
            for i, e in zip(other, encode([texts[i] for i in other], add_special_tokens=False), strict=True):
                got[i] = e.ids
            n = len(self.place)
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            total = int(sizes.sum())
            while n + len(part) > len(self.start):
                self.start, self.size = np.concatenate([self.start] * 2), np.concatenate([self.size] * 2)
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids] * 2)
            self.start[n : n + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(part)] = sizes
            self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
            self.used += total
            self.place.update(zip(part, range(n, n + len(part)), strict=True))

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, dtype=np.uint32) for e in encode([t.decode() for t in texts], add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_chunk:
            return [ids for part in slices(texts) for ids in self._whole(texts[part])]
        out = []
        for part in slices(texts, 4 << 20):
            w = Words([t.translate(_BLANKS) for t in texts[part]])
            _, first, inverse = np.unique(w.hashes(0), return_index=True, return_inverse=True)
            raw = w.buf.tobytes()
            chunks = [raw[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
            new = [c for c in chunks if c not in self.place]
            if new:
                if len(self.place) + len(new) > self.most and self.place:
                    self.clear()
                    new = chunks
                self._add(new)
            ix = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))[inverse]
            flat = self.ids[ragged(self.start[ix], self.size[ix])]
            ends = np.concatenate([[0], np.cumsum(self.size[ix])])
            cut = ends[np.concatenate([w.first, [len(ix)]])].tolist()
            out += [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return out


@cache
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


class FirstFit:
    """First bin with room enough, over a complete tournament tree of free room."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, room it had)."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        had = tree[at]
        where = at - self.leaves
        tree[at] = had - size
        at >>= 1
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at >>= 1
        return where, had


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, sizes taken in decreasing order (ties in the order given)."""
    order = np.argsort(-sizes, kind="stable")
    full = int(np.count_nonzero(sizes == room))  # these come first and fill a bin each
    where, offset = np.empty(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    where[order[:full]] = np.arange(full)
    rest = order[full:]
    if len(rest):
        fit = FirstFit(len(rest), room)
        got = [fit.place(s) for s in sizes[rest].tolist()]
        where[rest] = full + np.array([g[0] for g in got])
        offset[rest] = room - np.array([g[1] for g in got])
    return where, offset


def pieces(docs: DataFrame, tokenizer_path: str, *, room: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, with ``end_id`` after them, cut into pieces of ``room`` and a rest; ``row`` tells documents apart."""
    names = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        tok = chunk_tokenizer(tokenizer_path)
        try:
            for b in (part for whole in batches for part in B.by_bytes(whole, 2, 4 << 20)):
                rows = []
                for row, doc, got in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), tok.encode(texts_of(b.column(2))), strict=True):
                    full = np.append(got, np.uint32(end_id)).astype("<u4")
                    rows += [(row, doc, s, min(room, len(full) - s), zlib.crc32(full[s : s + room].tobytes()), len(full)) for s in range(0, len(full), room)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
        finally:
            tok.clear()

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(B.released(run), ", ".join(f"{c} long" for c in names))


def pack(docs: DataFrame, tokenizer_path: str, *, room: int = 2048, end_id: int = 1, group_pieces: int = 20_000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ws = Workspace(docs.sparkSession)
    cut = ws.keep(pieces(docs, tokenizer_path, room=room, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    n_groups = max(1, round(cut.count() / group_pieces))
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n_groups)))

    def group(t: pa.Table) -> pa.Table:
        t = t.sort_by([("row", "ascending"), ("start", "ascending")])
        where, offset = first_fit_decreasing(np.asarray(t.column("length")), room)
        g = t.column("grp")[0].as_py()
        return t.drop_columns(["grp", "row"]).append_column("sequence_id", pa.array(where + (g << 32), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("grp").applyInArrow(group, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
