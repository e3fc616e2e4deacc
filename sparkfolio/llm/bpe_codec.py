"""Byte-level BPE encoding and decoding over a shuffle of distinct words.

Texts are split where they lie.  A *chunk* is what one task reads up to a
bound; in it each distinct word has a number, and a text is the sequence of
the numbers of its words by position.  Only a chunk's distinct words go into
the shuffle by word, those of one part (a hash of the word) packed together;
there each distinct word of the corpus is encoded once.  The ids return to
their chunk and replace the numbers by position.  A word that occurs
everywhere is thus sent once for each chunk, not once for each occurrence.
Decoding joins ids with the table of token bytes, whose size is that of the
vocabulary.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.common import col, fresh, written
from sparkfolio.llm.pretokenize import splitter

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: A chunk ends with the document that brings it to so many characters or distinct words.
CHUNK_CHARS, CHUNK_WORDS = 32_000_000, 400_000
#: Positions of one stored sequence.
STREAM = 1 << 20
#: Characters of the input for each part by which words are dealt, and the least and most parts.
PART_CHARS, PART_RANGE = 8_000_000, (64, 1 << 12)
#: Distinct words of a part that are remembered; a part with more encodes some of them again.
REMEMBERED = 1_000_000
#: Packed bytes that one task of a shuffle reads, about.
TASK_BYTES = 32_000_000
#: No byte of UTF-8, so it can stand between words.
_BETWEEN = b"\xff"


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes on end, and each id's start and length in them."""
    by_id = {rank: token for token, rank in ranks(path).items()}
    length = np.zeros(max(by_id, default=-1) + 1, dtype=np.int64)
    for rank, token in by_id.items():
        length[rank] = len(token)
    flat = b"".join(by_id[r] for r in sorted(by_id))
    return np.frombuffer(flat, dtype=np.uint8), np.cumsum(length) - length, length


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` that ``index`` names, on end."""
    n = length[index]
    stop = np.cumsum(n)
    return flat[np.repeat(start[index] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]


#: Numbers below SHORT take a byte, below LONG three; each byte is stored with its like, which compresses best.
SHORT, LONG = 192, 192 + 63 * (1 << 14)


def _pack(values: np.ndarray) -> bytes:
    """Numbers below 2**32, small ones best."""
    v = values.astype(np.uint32)
    middle = v[(v >= SHORT) & (v < LONG)] - np.uint32(SHORT)
    first = np.where(v < SHORT, v, 255).astype(np.uint8)
    first[(v >= SHORT) & (v < LONG)] = SHORT + (middle >> np.uint32(14))
    planes = [first, middle & np.uint32(255), middle >> np.uint32(8) & np.uint32(63), v[v >= LONG]]
    packed = [zstandard.compress((p if k == 3 else p.astype(np.uint8)).tobytes(), 3) for k, p in enumerate(planes)]
    return np.array([len(p) for p in packed], dtype="<u4").tobytes() + b"".join(packed)


def _unpack(packed: bytes) -> np.ndarray:
    ends = (16 + np.cumsum(np.frombuffer(packed, dtype="<u4", count=4))).tolist()
    first, low, high, large = (
        np.frombuffer(zstandard.decompress(packed[a:b]), dtype=np.uint32 if k == 3 else np.uint8)
        for k, (a, b) in enumerate(zip([16, *ends], ends))
    )
    out = first.astype(np.int64)
    middle = (first >= SHORT) & (first < 255)
    out[middle] = SHORT + (out[middle] - SHORT << 14) + (high.astype(np.int64) << 8) + low
    out[first == 255] = large
    return out


def _chunks(batches: Iterator[pa.RecordBatch], split, kind: pa.DataType, parts: int) -> Iterator[pa.RecordBatch]:
    """By chunk: sequences of word numbers, the part of each number, and each part's words by number."""
    schema = pa.schema([("chunk", pa.int64()), ("first", pa.int32()), ("part", pa.int32()), ("packed", pa.binary()), ("ids", pa.list_(kind)), ("lens", pa.list_(pa.int32()))])
    base, serial = TaskContext.get().partitionId() << 32, 0

    def row(**x):
        return pa.RecordBatch.from_arrays([pa.array([x.get(f.name)], f.type) for f in schema], schema=schema)

    def ended():
        """The chunk's rows; its words are numbered anew, the most frequent ones first.

        A word that comes only once needs no number: it is 0, and the k-th 0 is
        the k-th such word.
        """
        raw = [w.encode() for w in words]
        every = np.concatenate(seqs)
        times = np.bincount(every, minlength=len(raw))
        order, repeated = np.argsort(-times, kind="stable"), int((times > 1).sum())
        number = np.zeros(len(raw), dtype=np.uint32)
        number[order[:repeated]] = np.arange(1, repeated + 1, dtype=np.uint32)
        stops = np.cumsum([abs(n + (n < 0)) for n in lens]).tolist()
        place = at = 0
        for k, stop in enumerate(stops):
            if stop - (stops[at - 1] if at else 0) >= STREAM or k - at >= 10_000 or k + 1 == len(stops):
                part = every[stops[at - 1] if at else 0 : stop]
                yield row(chunk=base + serial, first=place, ids=ids[at : k + 1], lens=lens[at : k + 1], packed=_pack(number[part]))
                place, at = place + 1, k + 1
        part = np.fromiter((zlib.crc32(raw[i]) % parts for i in order.tolist()), dtype=np.uint16, count=len(raw))
        yield row(chunk=base + serial, first=_PARTS_ROW, lens=[repeated], packed=zstandard.compress(part.tobytes(), 3))
        dealt = np.argsort(part, kind="stable")
        for numbers in np.split(dealt, np.flatnonzero(np.diff(part[dealt])) + 1) if len(raw) else []:
            yield row(chunk=base + serial, part=int(part[numbers[0]]), packed=zstandard.compress(_BETWEEN.join([raw[i] for i in order[numbers].tolist()]), 3))

    def begun():
        words = defaultdict()
        words.default_factory = words.__len__
        return words, 0, [], [], []

    words, chars, ids, lens, seqs = begun()
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py() or ""
            pieces = split(text)
            # A text longer than a stored sequence is continued; a length below zero marks all but its last part.
            for k in range(0, len(pieces) or 1, STREAM):
                seq = np.fromiter(map(words.__getitem__, pieces[k : k + STREAM]), dtype=np.uint32)
                ids.append(doc.as_py())
                lens.append(len(seq) if k + STREAM >= len(pieces) else -1 - len(seq))
                seqs.append(seq)
            chars += len(text)
            if chars >= CHUNK_CHARS or len(words) >= CHUNK_WORDS:
                yield from ended()
                serial += 1
                words, chars, ids, lens, seqs = begun()
    if ids:
        yield from ended()


#: Places of a chunk's rows before its sequences.
_IDS_ROW, _PARTS_ROW = -2, -1


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Ids of words that come sorted by part: each distinct word is encoded once and joins every chunk that has it."""
    single, last = encoding(path).encode_ordinary, None
    known: dict[bytes, list[int]] = {}
    for batch in batches:
        chunks, parts, packs = batch.column(0), batch.column(1).to_pylist(), []
        for part, packed in zip(parts, batch.column(2)):
            if part != last or len(known) > REMEMBERED:
                last, known = part, {}
            found = []
            for word in zstandard.decompress(packed.as_py()).split(_BETWEEN):
                ids = known.get(word)
                if ids is None:
                    # A word is one match of the pattern, and so it is by itself.
                    ids = known[word] = single(word.decode())
                found.append(ids)
            packs.append(_pack(np.array([len(found), *map(len, found), *itertools.chain.from_iterable(found)])))
        yield pa.RecordBatch.from_arrays([chunks, batch.column(1), pa.array(packs, pa.binary())], ["chunk", "part", "packed"])


def _assembled(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Texts as ids, from rows sorted by chunk: the parts' ids, the part of each number, the sequences."""
    now, packs, table, single = None, {}, None, 0  # single: the next word that comes once
    held: list[np.ndarray] = []

    def tabled(part: np.ndarray):
        """All ids on end, and each number's start and length in them."""
        sizes, flats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p in sorted(packs):
            values = _unpack(packs[p])
            n = int(values[0])
            sizes.append(values[1 : 1 + n])
            flats.append(values[1 + n :])
        size, order = np.concatenate(sizes), np.argsort(part, kind="stable")
        start, length = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        start[order], length[order] = np.cumsum(size) - size, size
        return np.concatenate(flats).astype(np.int32), start, length

    for batch in batches:
        chunks, first, part, packed, ids, lens = (batch.column(k) for k in range(6))
        for r, (chunk, place) in enumerate(zip(chunks.to_pylist(), first.to_pylist())):
            if chunk != now:
                now, packs, table = chunk, {}, None
            if place == _IDS_ROW:
                packs[part[r].as_py()] = packed[r].as_py()
                continue
            if place == _PARTS_ROW:
                table = tabled(np.frombuffer(zstandard.decompress(packed[r].as_py()), dtype=np.uint16))
                packs, single = {}, lens[r][0].as_py()
                continue
            seq = _unpack(packed[r].as_py()) - 1
            once = np.flatnonzero(seq < 0)
            seq[once] = single + np.arange(len(once))
            single += len(once)
            names, out, at = [], [], 0
            for name, n in zip(ids[r].as_py(), lens[r].as_py()):
                m = n if n >= 0 else -1 - n
                found = gathered(*table, seq[at : at + m])
                at += m
                if n < 0:
                    held.append(found)
                    continue
                names.append(name)
                out.append(np.concatenate([*held, found]) if held else found)
                held.clear()
            stop = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.ListArray.from_arrays(pa.array(stop), flat)], ["id", "ids"])


def _arrow_type(docs: DataFrame, id_col: str) -> tuple[T.DataType, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.select(col(id_col)).schema[0].dataType
    return kind, to_arrow_type(kind)


def _placed(docs: DataFrame, path: str, id_col: str, text_col: str) -> tuple[DataFrame, str, pa.DataType]:
    """What ``_assembled`` puts texts together from, sorted by chunk, and the type of ids."""
    import public_tokenizers

    pattern = public_tokenizers.PATTERN
    kind, arrow = _arrow_type(docs, id_col)
    name = kind.simpleString()
    chars = docs.agg(F.sum(F.length(col(text_col).cast("string")))).first()[0] or 0
    parts = min(max(chars // PART_CHARS, PART_RANGE[0]), PART_RANGE[1])
    chunks = written(
        docs.select(col(id_col), col(text_col).cast("string")).mapInArrow(
            lambda it: _chunks(it, splitter(pattern), arrow, parts),
            f"chunk long, first int, part int, packed binary, ids array<{name}>, lens array<int>",
        ),
        "chunks",
    )
    is_word = F.col("part").isNotNull()
    size = lambda of: F.coalesce(F.sum(F.when(of, F.octet_length("packed"))), F.lit(0))
    of_words, of_rest, n = chunks.agg(size(is_word), size(~is_word), F.count_distinct("chunk")).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda size, most: max(1, min(most, max(least, -(-size // TASK_BYTES))))
    words = chunks.where(is_word).select("chunk", "part", "packed").repartition(tasks(of_words, parts), "part").sortWithinPartitions("part")
    encoded = words.mapInArrow(lambda it: _encoded(it, path), "chunk long, part int, packed binary")
    nothing = lambda t: F.lit(None).cast(t)
    joined = encoded.select("chunk", F.lit(_IDS_ROW).alias("first"), "part", "packed", nothing(f"array<{name}>").alias("ids"), nothing("array<int>").alias("lens")).unionAll(
        chunks.where("part is null").select("chunk", "first", "part", "packed", "ids", "lens")
    )
    placed = joined.repartition(tasks(of_words + of_rest, n), "chunk").sortWithinPartitions("chunk", "first")
    return placed, name, arrow


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``ids array<int>`` per row of ``docs``.

    Special tokens are not recognised: their strings are ordinary text.  A
    null text is an empty one and has no ids.  Rows are told apart by place,
    so repeated rows and repeated or null ids come back as often as they came.
    The parts that words are dealt by grow with the characters of the input, the
    partitions of both shuffles with the packed bytes, so what a task reads and
    remembers does not.  An empty table gives an empty one.
    """
    placed, name, arrow = _placed(docs, path, id_col, text_col)
    return placed.mapInArrow(lambda it: _assembled(it, arrow), f"id {name}, ids array<int>")


def decoded(ids: pa.ListArray, path: str) -> Iterator[bytes | None]:
    """The bytes that lists of ids stand for, by the token-byte table; null lists stand for null."""
    flat, start, length = token_bytes(path)
    stop, values, null = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False), ids.is_null().to_pylist()
    for n, a, b in zip(null, stop, stop[1:]):
        yield None if n else gathered(flat, start, length, values[a:b]).tobytes()


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` and a binary column ``decoded``; null ids decode to null, no ids to no bytes.

    The table of token bytes has as many rows as the vocabulary, so each task
    holds it whole.  An id outside the vocabulary is an error.
    """

    @F.arrow_udf(T.BinaryType())
    def of(ids: pa.Array) -> pa.Array:
        return pa.array(decoded(ids, path), pa.binary())

    (name,) = fresh(encoded, "decoded")
    return encoded.select("*", of(col(ids_col)).alias(name))


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Number and digest of the ids of each text, and digest of the bytes that they decode to."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for batch in batches:
        ids = batch.column(1)
        stop, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        listed = [sha(",".join(map(str, values[a:b].tolist())).encode()) for a, b in zip(stop, stop[1:])]
        columns = [pa.array(np.diff(stop).astype(np.int64)), pa.array(listed, pa.string()), pa.array([sha(x) for x in decoded(ids, path)], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each whole text, encoded and decoded.

    Ids and bytes are digested where texts are put together, so they never go
    back to the engine.
    """
    placed, name, arrow = _placed(docs, path, id_col, text_col)
    return placed.mapInArrow(lambda it: _digests(_assembled(it, arrow), path), f"doc_id {name}, n_tokens long, ids_sha256 string, decoded_sha256 string")
