from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sparkfolio.llm import bpe_codec, token_counts

SCHEMA = "doc_id bigint, text string, ids string, stream int, chunk string, n_tokens int"
MULTI = P.path(bpe_codec.TOKENIZER)
BYTE = P.path(token_counts.TOKENIZER)


def texts():
    rng = random.Random(3)
    words = ["the", " and", "Über", "naïve", "日本語", "🤣", "  ", "\n\n", "don't", "x1y2", "½", "\x1c", "\x85", "<|endoftext|>", "\t", "ʼn", "ﬁ", "é", "𝔘𝔫"]
    out = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    out += [None, "", " ", "a", "a" * 20000, "ab " * 30000, " " * 5000, "<|endoftext|>", "<|endoftext|> <|endoftext|>x", "\x00", "0123456789" * 40]
    out += ["".join(map(chr, range(a, a + 500))) for a in range(0x80, 0x3000, 500)]
    return out + out[:7]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 9 else None, t, "i", 1, "c", 2) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[1], rows[1]], SCHEMA).repartition(4)


def expected(rows):
    enc = bpe_codec.encoding(MULTI)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    return sorted(out, key=str)


def test_codec_round_trip(docs):
    got = sorted([tuple(r) for r in bpe_codec.round_trip(docs, MULTI).collect()], key=str)
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_small_chunks_and_continued_texts(docs, monkeypatch):
    import pyarrow as pa

    class Here:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(bpe_codec.TaskContext, "get", staticmethod(lambda: Here))
    for name, value in (("CHUNK_CHARS", 900), ("STREAM", 7)):
        monkeypatch.setattr(bpe_codec, name, value)
    rows = [(i, t) for i, t in enumerate(texts()) if len(t or "") < 3000]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    chunks = pa.Table.from_batches(bpe_codec._chunks(iter([batch.slice(0, 50), batch.slice(50)]), bpe_codec.splitter(P.PATTERN), pa.int64(), 5)).to_pylist()
    words = sorted((r for r in chunks if r["part"] is not None), key=lambda r: r["part"])
    fed = pa.RecordBatch.from_arrays([pa.array([r[c] for r in words]) for c in ("chunk", "part", "packed")], ["chunk", "part", "packed"])
    encoded = pa.Table.from_batches(bpe_codec._encoded(iter([fed.slice(0, 9), fed.slice(9)]), MULTI)).to_pylist()
    sorted_rows = [(r["chunk"], -2, r["part"], r["packed"], None, None) for r in encoded]
    sorted_rows += [tuple(r.values()) for r in chunks if r["part"] is None]
    sorted_rows.sort(key=lambda r: r[:2])
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    fed = pa.RecordBatch.from_arrays([pa.array([r[k] for r in sorted_rows], t) for k, t in enumerate(types)], list("abcdef"))
    out = list(bpe_codec._assembled(iter([fed.slice(0, 11), fed.slice(11)]), pa.int64()))
    got = dict(zip((i for b in out for i in b.column(0).to_pylist()), (x for b in out for x in b.column(1).to_pylist())))
    enc = bpe_codec.encoding(MULTI)
    assert len({r[0] for r in sorted_rows}) > 3
    assert got == {i: enc.encode_ordinary(t or "") for i, t in rows}


def test_packed_numbers_at_their_limits():
    import numpy as np

    short, long = bpe_codec.SHORT, bpe_codec.LONG
    edges = [0, 1, short - 1, short, short + 1, short + (1 << 14) - 1, short + (1 << 14), long - 1, long, long + 1, 2**32 - 1]
    rng = random.Random(1)
    for values in ([], edges, edges[::-1], [2**32 - 1] * 9, [rng.choice(edges) for _ in range(5000)], list(range(70000))):
        assert bpe_codec._unpack(bpe_codec._pack(np.array(values, dtype=np.int64))).tolist() == values


def test_chunks_end_at_their_bounds(monkeypatch):
    import pyarrow as pa

    class Here:
        partitionId = staticmethod(lambda: 1)

    monkeypatch.setattr(bpe_codec.TaskContext, "get", staticmethod(lambda: Here))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(["ab cd", None, "ab", "", "x y z", "ab"])], ["doc_id", "text"])
    run = lambda: pa.Table.from_batches(bpe_codec._chunks(iter([batch]), bpe_codec.splitter(P.PATTERN), pa.int64(), 3)).to_pylist()
    whole = run()
    assert {r["chunk"] for r in whole} == {1 << 32} and [r["ids"] for r in whole if r["ids"]] == [[0, 1, 2, 3, 4, 5]]
    assert [r["lens"] for r in whole if r["first"] == -1] == [[1]]  # "ab" is the only word that comes twice
    monkeypatch.setattr(bpe_codec, "CHUNK_CHARS", 5)
    assert [r["ids"] for r in run() if r["ids"]] == [[0], [1, 2, 3, 4], [5]]
    monkeypatch.setattr(bpe_codec, "CHUNK_CHARS", 10**9)
    monkeypatch.setattr(bpe_codec, "CHUNK_WORDS", 2)
    assert [r["ids"] for r in run() if r["ids"]] == [[0], [1, 2, 3, 4], [5]]
    monkeypatch.setattr(bpe_codec, "STREAM", 1)
    assert [r["lens"] for r in run() if r["ids"]][:2] == [[-2], [1]]


def test_words_that_are_forgotten_are_encoded_again(docs, monkeypatch):
    import pyarrow as pa
    import zstandard

    monkeypatch.setattr(bpe_codec, "REMEMBERED", 1)
    packs = [zstandard.compress(b"\xff".join(w)) for w in ([b"the", b" and"], [b" and", b"xyzzy"], [b"the"])]
    fed = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0], pa.int32()), pa.array(packs, pa.binary())], ["chunk", "part", "packed"])
    (out,) = bpe_codec._encoded(iter([fed]), MULTI)
    enc = bpe_codec.encoding(MULTI).encode_ordinary
    for got, words in zip(out.column(2).to_pylist(), (["the", " and"], [" and", "xyzzy"], ["the"])):
        ids = [enc(w) for w in words]
        assert bpe_codec._unpack(got).tolist() == [len(words), *map(len, ids), *[i for x in ids for i in x]]


def test_each_match_is_one_by_itself():
    """What lets a distinct word be encoded alone by the library's public call."""
    split = bpe_codec.splitter(P.PATTERN)
    for t in texts():
        assert all(split(w) == [w] for w in set(split(t or "")))


def test_decode_alone(spark):
    enc = bpe_codec.encoding(MULTI)
    df = spark.createDataFrame([(1, enc.encode_ordinary("Grüße, 世界")), (2, []), (3, None)], "id long, ids array<int>")
    assert [r.decoded if r.decoded is None else bytes(r.decoded) for r in bpe_codec.decode(df, MULTI).orderBy("id").collect()] == ["Grüße, 世界".encode(), b"", None]


def test_counts_match_the_library(docs):
    library = Tokenizer.from_file(BYTE)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    n = [len(e.ids) for e in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want = sorted([(i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(rows, n)], key=str)
    assert sorted([tuple(r) for r in token_counts.token_counts(docs, BYTE).collect()], key=str) == want


def test_remembered_counts_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    m = token_counts.MergeCounter(BYTE)
    library = Tokenizer.from_file(BYTE)
    text = " ".join(f"word{i}" for i in range(200))
    assert m.count(text) == len(library.encode(text).ids) and len(m.known) <= 10


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe_codec.round_trip(empty, MULTI).collect() == []
    assert token_counts.token_counts(empty, BYTE).collect() == []
