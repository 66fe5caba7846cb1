"""Alignment of two tokenizers against a token by token comparison."""

import hashlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import token_align
from tessera.llm.token_align import ByteVocabulary, PieceVocabulary, Slice, Speller, align, merged, run_lengths

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [None, "", "x", " lead", "a  b   c ", "▁x y", "<|endoftext|> <s> </s> <unk> <0x0A>", "é ü é 你好 🙂🙂\x00\n\t\r\n", "a" * 3000, "don't  we'll 12345 ...!?", "ﬁ ½ ﷺ", "\n\n", " "]


def brute(rows):
    ta, sb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    links, out = [], []
    for i, t in rows:
        a = ta.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sb.encode(t) if t else []
        bytes_a = [bytes(letters[c] for c in ta.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(sb.id_to_piece(x)[3:5], 16)]) if sb.is_byte(x) else sb.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            a = b = bytes_a = bytes_b = []
        owner_a = [k for k, x in enumerate(bytes_a) for _ in x]
        owner_b = [k for k, x in enumerate(bytes_b) for _ in x]
        pairs = sorted(set(zip(owner_a, owner_b, strict=True)))
        ends_a, ends_b = (np.cumsum([len(x) for x in s]).tolist() for s in (bytes_a, bytes_b))
        groups, pa, pb = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            na, nb = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, a[pa:na])) + "|" + ",".join(map(str, b[pb:nb])))
            pa, pb = na, nb
        links.append([(a[x], b[y]) for x, y in pairs])
        out.append((i, len(a), len(b), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(p for own in links for p in set(own))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return Counter((*o[:5], sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own), o[5]) for o, own in zip(out, links, strict=True))


def test_alignment_matches_brute_force(spark, docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "again"), (1002, "x"), (2**63 - 1, "x y")]
    rows.append((7777, "é " * 2000 + "long words " * 9000))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"slice": F.lit(1), "key": F.lit("k"), "n": F.lit(0)})
    want = brute(rows)
    assert Counter(map(tuple, align(df, A, B).collect())) == want
    assert sum(r[1] == 0 for r in want.elements()) >= 4


def test_nothing_and_only_empty_texts(spark, nothing):
    assert align(nothing, A, B).collect() == []
    got = align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_undecodable_text_has_no_tokens(spark):
    df = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text union all select 2L, 'ab'")
    got = {r.doc_id: r.n_a for r in align(df, A, B).collect()}
    assert got[1] == 0 and got[2] > 0


def test_counts_through_a_folder_that_is_not_mounted(spark, docs, tmp_path, monkeypatch):
    """Shards written as a table and fetched by every machine."""
    real = token_align.urlparse
    monkeypatch.setattr(token_align, "urlparse", lambda x: SimpleNamespace(scheme="far", path=real(x).path))
    small = docs.select("doc_id", "text").limit(25)
    assert Counter(map(tuple, align(small, A, B).collect())) == brute([(r.doc_id, r.text) for r in small.collect()])


def test_fast_paths_give_the_libraries_ids():
    own, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    own.encode_special_tokens = True
    texts = [t for t in ODD if t] + ["".join(map(chr, range(0x20, 0x3000))), " ".join(f"{chr(c)}a{chr(c)}1" for c in range(0x3000, 0x12000, 7) if not 0xD800 <= c < 0xE000)]
    plain = lambda rows: [None if x is None else x.tolist() for x in rows]
    a, b = ByteVocabulary(A), PieceVocabulary(B, most=40)
    assert a.lossless and b.by_word
    assert plain(a.aligned(texts)) == [own.encode(" " + t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # words met before, and a cache that was cleared
        got = [plain(b.aligned([t]))[0] for t in texts]
        assert all(x == (y if b.bytes_of(np.array(y, dtype=np.int64)) == b" " + t.encode() else None) for x, y, t in zip(got, model.encode(texts), texts, strict=True))


def test_spelling():
    said = Speller(50_256)(np.array([0, 7, 10, 999, 50_256]), np.array([1, 2, 1, 3, 1], dtype=np.uint8))
    assert said == b"0,7|10,999;50256,"


def test_run_lengths_across_batches():
    import pyarrow as pa

    parts = [([1, 1], [1, 2]), ([1], [4]), ([], []), ([1, 2, 5], [8, 1, 1]), ([5], [1])]
    got = list(run_lengths(pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["key", "n"]) for k, n in parts))
    assert [(int(k), int(n)) for ks, ns in got for k, n in zip(ks, ns, strict=True)] == [(1, 15), (2, 1), (5, 2)]
    keys, counts = merged([(np.array([3, 9]), np.array([1, 1])), (np.array([1, 9]), np.array([5, 1]))])
    assert keys.tolist() == [1, 3, 9] and counts.tolist() == [5, 1, 2]


@pytest.mark.parametrize("held", [50])
def test_partial_counts_meet(spark, docs, held):
    few = docs.select("doc_id", "text").limit(20)
    rows = [(r.doc_id, r.text) for r in few.collect()]
    slices = token_align.sliced(few, A, B, "doc_id", "text")
    got = Counter()
    for r in token_align.partial_counts(slices, A, B, held).collect():
        got[r.key] += r.n
    want = Counter()
    a, b = ByteVocabulary(A), PieceVocabulary(B)
    for _, t in rows:
        x, y = token_align.tokenise([(t or "").encode()], a, b)
        blob = token_align.arrays(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.uint8), *[np.array([len(s[0])], dtype=np.int64) for s in (x, y)], *[np.array(s[0], dtype=np.int32) for s in (x, y)])
        want.update(set(Slice(blob, a, b).keys.tolist()))
    assert got == want
