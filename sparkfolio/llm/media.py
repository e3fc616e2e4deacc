"""Media columns: signature sniffing, structure checks, type correction and carving.

An Aho-Corasick automaton finds all magic bytes of a column value in one pass.
A format's validator then follows its structure from there and gives its
length, or none if structure or lengths don't hold, so magic bytes alone never
make a medium.  What starts at the first byte decides the value's type, which
corrects the declared one; valid media further in that lie in no other are
carved.  Terminators are looked up in lists made once for each value, and walks
that meet go on as one, so magic bytes repeated all over a value don't make the
work grow with its square.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import col

UNIT = 64
RATE = 8000
#: What a text is declared to be where nothing else is said.
DECLARED = "text/plain"
#: Payload bytes after which a batch of rows is passed on.
BATCH_BYTES = 16_000_000
#: Bytes that are unpacked, and what may come out, at a time.
GZIP_PIECE, GZIP_OUT = 1 << 16, 1 << 20


def to_wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples: each byte is a sample."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def padded(raw: bytes) -> bytes:
    """``raw`` and zero bytes up to a positive multiple of UNIT."""
    return raw + b"\0" * (-len(raw) % UNIT or (UNIT if not raw else 0))


class Value:
    """The bytes of one value, with what validators share about them."""

    def __init__(self, data: bytes) -> None:
        self.data, self.view, self.places, self.walked = data, memoryview(data), {}, {}

    def after(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on, or -1; all places are found once."""
        if mark not in self.places:
            found, i = [], self.data.find(mark)
            while i >= 0:
                found.append(i)
                i = self.data.find(mark, i + 1)
            self.places[mark] = found
        places = self.places[mark]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def before(self, mark: bytes, start: int, end: int) -> int:
        """The last place of ``mark`` that lies in ``start:end``, or -1."""
        self.after(mark, 0)
        places = self.places[mark]
        k = bisect_left(places, end - len(mark) + 1) - 1
        return places[k] if k >= 0 and places[k] >= start else -1


def riff_chunks(data: bytes, at: int) -> dict[bytes, tuple[int, int]] | None:
    """Place and length of each chunk of the RIFF file at ``at``; None if they don't add up."""
    if len(data) < at + 12:
        return None
    end, out = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little"), {}
    if end > len(data):
        return None
    i = at + 12
    while i + 8 <= end:
        n = int.from_bytes(data[i + 4 : i + 8], "little")
        if i + 8 + n > end:
            return None
        out.setdefault(bytes(data[i : i + 4]), (i + 8, n))
        i += 8 + n + n % 2
    return out if i in (end, end + 1) else None


def _riff(value: Value, at: int) -> tuple[str, int] | None:
    data = value.data
    kind = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}.get(data[at + 8 : at + 12])
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    # Files that end in one place and meet in a chunk are the same from there on.
    if kind is None or end > len(data) or _walked(value, ("riff", end), at + 12, lambda i: _riff_step(data, i, end)) is None:
        return None
    if kind == "audio/wav" and not {b"fmt ", b"data"} <= (riff_chunks(data, at) or {}).keys():
        return None
    return kind, end - at


def _riff_step(data: bytes, i: int, end: int) -> tuple[int | None, int | None]:
    if i + 8 > end:
        return None, end if i in (end, end + 1) else None
    n = int.from_bytes(data[i + 4 : i + 8], "little")
    return (None, None) if i + 8 + n > end else (i + 8 + n + n % 2, None)


def _walked(value: Value, kind: object, i: int, step: Callable[[int], tuple[int | None, int | None]]) -> int | None:
    """Where a walk from ``i`` ends, by steps ``(next place or None, end or None)``; each place is walked from once."""
    path, known = [], value.walked.setdefault(kind, {})
    while i not in known:
        path.append(i)
        following, end = step(i)
        if following is None:
            break
        i = following
    else:
        end = known[i]
    for k in path:
        known[k] = end
    return end


def _png(value: Value, at: int) -> tuple[str, int] | None:
    data = value.data
    if data[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return None
    # Lengths first: only a chain that ends well is worth its checksums.
    end = _walked(value, "png", at + 8, lambda i: _png_step(data, i))
    i = at + 8
    while end is not None and i < end:
        n = int.from_bytes(data[i : i + 4], "big")
        right = value.walked.setdefault("png sums", {})
        if i not in right:
            right[i] = zlib.crc32(value.view[i + 4 : i + 8 + n]) == int.from_bytes(data[i + 8 + n : i + 12 + n], "big")
        if not right[i]:
            return None
        i += 12 + n
    return ("image/png", end - at) if end is not None else None


def _png_step(data: bytes, i: int) -> tuple[int | None, int | None]:
    n = int.from_bytes(data[i : i + 4], "big")
    past = i + 12 + n
    if i + 12 > len(data) or past > len(data):
        return None, None
    return (None, past) if data[i + 4 : i + 8] == b"IEND" else (past, None)


def _gif(value: Value, at: int) -> tuple[str, int] | None:
    data = value.data
    if at + 13 > len(data):
        return None
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0

    # Places of blocks are even numbers of a walk, those of the sub-blocks within them odd ones.
    def step(place: int) -> tuple[int | None, int | None]:
        i, within = place >> 1, place & 1
        if i >= len(data):
            return None, None
        if within:
            return ((i + data[i] + 1) << 1 | 1 if data[i] else (i + 1) << 1), None
        if data[i] == 0x3B:
            return None, i + 1
        if data[i] == 0x21:
            return (i + 2) << 1 | 1, None
        if data[i] == 0x2C and i + 10 < len(data):
            return (i + 11 + table(data[i + 9])) << 1 | 1, None
        return None, None

    end = _walked(value, "gif", (at + 13 + table(data[at + 10])) << 1, step)
    return ("image/gif", end - at) if end is not None else None


def _jpeg(value: Value, at: int) -> tuple[str, int] | None:
    data = value.data

    def step(i: int) -> tuple[int | None, int | None]:
        n = int.from_bytes(data[i + 2 : i + 4], "big")
        if i + 4 > len(data) or data[i] != 0xFF or n < 2:
            return None, None
        if data[i + 1] != 0xDA:
            return i + 2 + n, None
        end = value.after(b"\xff\xd9", i + 2 + n)
        return None, end + 2 if end >= 0 else None

    end = _walked(value, "jpeg", at + 2, step)
    return ("image/jpeg", end - at) if end is not None else None


def _pdf(value: Value, at: int) -> tuple[str, int] | None:
    data = value.data
    if not (data[at + 5 : at + 6].isdigit() and data[at + 6 : at + 7] == b"." and data[at + 7 : at + 8].isdigit()):
        return None
    following = value.after(b"%PDF-", at + 5)
    end = value.before(b"%%EOF", at, following if following >= 0 else len(data))
    return ("application/pdf", end + 5 - at) if end >= 0 and value.before(b"startxref", at, end) >= 0 else None


def _zip(value: Value, at: int) -> tuple[str, int] | None:
    data, end = value.data, value.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return None
    size, start, note = struct.unpack("<IIH", data[end + 12 : end + 22])
    ok = at + start + size == end and data[at + start : at + start + 4] == b"PK\x01\x02"
    return ("application/zip", end + 22 + note - at) if ok and end + 22 + note <= len(data) else None


def _gzip(value: Value, at: int) -> tuple[str, int] | None:
    """Unpacked in pieces and let go at the first fault; a value of valid streams within streams takes one pass for each."""
    unzip, i = zlib.decompressobj(31), at
    try:
        while i < len(value.data) and not unzip.eof:
            piece = value.view[i : i + GZIP_PIECE]
            i += len(piece)
            unzip.decompress(piece, GZIP_OUT)
            while unzip.unconsumed_tail and not unzip.eof:
                unzip.decompress(unzip.unconsumed_tail, GZIP_OUT)
    except zlib.error:
        return None
    return ("application/gzip", i - at - len(unzip.unused_data)) if unzip.eof else None


#: Magic bytes and the validator of their format.
FORMATS: tuple[tuple[bytes, Callable[[Value, int], tuple[str, int] | None]], ...] = (
    (b"RIFF", _riff), (b"\x89PNG\r\n\x1a\n", _png), (b"GIF87a", _gif), (b"GIF89a", _gif), (b"\xff\xd8\xff", _jpeg),
    (b"%PDF-", _pdf), (b"PK\x03\x04", _zip), (b"\x1f\x8b\x08", _gzip),
)


@functools.cache
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, (magic, _) in enumerate(FORMATS):
        out.add_word(magic.decode("latin-1"), (k, len(magic)))
    out.make_automaton()
    return out


def sniff(data: bytes) -> tuple[str, int, list[tuple[str, int, int]]]:
    """Type and length of what starts at the first byte, and ``(type, start, length)`` of media carved further in.

    Without a valid medium at the start the type is text/plain for UTF-8, else
    application/octet-stream, and the length that of the data.  What is found
    inside the first medium's own bytes is carved too, but nothing inside a
    carved one; of magic bytes in the same place the first valid ones count.
    """
    first, carved, past, value = None, [], 0, Value(data)
    for stop, (k, n) in automaton().iter(data.decode("latin-1")):
        at = stop - n + 1
        if at < past or not (found := FORMATS[k][1](value, at)):
            continue
        if at == 0 and first is None:
            first = found
        else:
            carved.append((found[0], at, found[1]))
            past = at + found[1]
    if first is None:
        try:
            data.decode()
            first = "text/plain", len(data)
        except UnicodeDecodeError:
            first = "application/octet-stream", len(data)
    return *first, carved


def _sliced(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, passed on when they hold BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= BATCH_BYTES or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _stored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``id, n_bytes, declared, media`` of texts ``id, text, declared``."""
    for batch in batches:
        raw = batch.column(1).cast(pa.large_binary())
        for i, x, declared in zip(batch.column(0), raw, batch.column(2)):
            x = x.as_py() or b""
            yield i.as_py(), len(x), declared.as_py(), to_wav(padded(x))


def read_back(media: bytes) -> tuple[bytes | None, str, str]:
    """Payload, type and features of a stored form, from its bytes alone; no payload if it isn't a WAV file."""
    what = (_riff(Value(media), 0) if media[:4] == b"RIFF" else None) or ("", 0)
    if what[0] != "audio/wav":
        what, length, carved = sniff(media)
        return None, what, f"{what};bytes={length}" + "".join(f";carved={t}@{s}+{m}" for t, s, m in carved)
    what = what[0]
    chunks = riff_chunks(media, 0)
    form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, chunks[b"fmt "][0])
    at, size = chunks[b"data"]
    payload = media[at : at + size]
    feature = f"{what};format={form};channels={channels};rate={rate};bits={bits};samples={size}"
    if size:
        v = np.frombuffer(payload, dtype=np.uint8)
        feature += f";min={v.min()};max={v.max()};sum={v.sum(dtype=np.int64)}"
    return payload, what, feature


def inspect(media: bytes, declared: str | None) -> tuple[bytes | None, str, bool, list[tuple[str, int, int]], str]:
    """Payload, type, whether that corrects the declared one, carved media and feature of a stored value.

    What is sniffed is the payload read back, or the value itself where it is
    no WAV file; places of carved media count from the start of what is sniffed.
    """
    payload, form, feature = read_back(media)
    what, length, carved = sniff(media if payload is None else payload)
    corrected = what != declared
    if payload is None:
        return None, what, corrected, carved, f"{feature};corrected={str(corrected).lower()}"
    feature += f";content={what};length={length};corrected={str(corrected).lower()}" + "".join(f";carved={t}@{s}+{m}" for t, s, m in carved)
    return payload, what, corrected, carved, feature


def _id_type(df: DataFrame, id_col: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.select(col(id_col)).schema[0].dataType
    return kind.simpleString(), to_arrow_type(kind)


def _texts(docs: DataFrame, id_col: str, text_col: str, declared: Column | None) -> DataFrame:
    declared = F.lit(DECLARED) if declared is None else declared
    return docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"), declared.cast("string").alias("declared"))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None) -> DataFrame:
    """``id, n_bytes, declared, media``: each text's padded UTF-8 bytes as the samples of a WAV file.

    A null text is an empty one; its payload is UNIT zero bytes.  ``declared``
    is a column with the content's type, text/plain where none is given.
    """
    name, kind = _id_type(docs, id_col)
    schema = pa.schema([("id", kind), ("n_bytes", pa.int64()), ("declared", pa.string()), ("media", pa.binary())])
    return _texts(docs, id_col, text_col, declared).mapInArrow(lambda it: _sliced(_stored_rows(it), schema), f"id {name}, n_bytes long, declared string, media binary")


def inspected(media: DataFrame) -> DataFrame:
    """``media(id, n_bytes, declared, media)`` with ``payload, type, corrected, carved, feature``, read from the bytes alone.

    ``corrected`` says that the type differs from the declared one, also where
    that is null.  The payload is that of a WAV file's data chunk, null for
    other types; the feature string has the samples' format, number, least,
    largest and sum, the content's type and the carved media.
    """
    name, kind = _id_type(media, "id")
    schema = pa.schema([
        ("id", kind), ("n_bytes", pa.int64()), ("declared", pa.string()), ("media", pa.binary()), ("payload", pa.binary()), ("type", pa.string()),
        ("corrected", pa.bool_()), ("carved", pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))), ("feature", pa.string()),
    ])

    def rows(batches):
        for batch in batches:
            for i, n, declared, data in zip(*batch.columns):
                data = data.as_py() or b""
                payload, what, corrected, carved, feature = inspect(data, declared.as_py())
                listed = [{"type": t, "start": s, "length": m} for t, s, m in carved]
                yield i.as_py(), n.as_py(), declared.as_py(), data, payload, what, corrected, listed, feature

    return media.select("id", "n_bytes", "declared", "media").mapInArrow(
        lambda it: _sliced(rows(it), schema),
        f"id {name}, n_bytes long, declared string, media binary, payload binary, type string, corrected boolean,"
        " carved array<struct<type: string, start: long, length: long>>, feature string",
    )


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None) -> DataFrame:
    """Digests of each text's stored form and of the payload read back from it.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature``.  Rows are independent: repeated rows and null ids
    come back as they came, equal texts of one declared type have equal values,
    and an empty table gives an empty one.  Media are made, read back and
    hashed in one place, so they never leave the worker.
    """
    name, kind = _id_type(docs, id_col)
    schema = pa.schema([
        ("doc_id", kind), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ])
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def rows(batches):
        for i, n, declared, media in _stored_rows(batches):
            payload, _, _, _, feature = inspect(media, declared)
            yield i, n, len(payload), sha(payload), zlib.crc32(payload[-UNIT:]), len(media), sha(media), feature

    return _texts(docs, id_col, text_col, declared).mapInArrow(
        lambda it: _sliced(rows(it), schema),
        f"doc_id {name}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
