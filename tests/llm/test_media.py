from __future__ import annotations

import gzip
import hashlib
import io
import random
import struct
import wave
import zipfile
import zlib

from sparkfolio.llm import media

SCHEMA = "id string, doc_id bigint, text string, media string, feature int"


def png():
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\0")) + part(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04JF\xff\xda\0\x02data\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"


def test_round_trip_of_texts(spark):
    texts = ["", None, "a", "x" * 63, "x" * 64, "x" * 65, "é🤣" * 40, "RIFF" * 30, "GIF89a", PDF.decode(), "long " * 60000, "a"]
    rows = [("i", i, t, "m", 1) for i, t in enumerate(texts)] + [("i", None, "none", "m", 1), ("i", 0, "", "m", 1)]
    got = media.media_columns(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = []
    for _, i, t, *_ in rows:
        raw = (t or "").encode()
        n = max(64, -(-len(raw) // 64) * 64)
        pay = raw + b"\0" * (n - len(raw))
        want.append((str(i), len(raw), n, hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    by_payload = {}
    for r in got:
        assert by_payload.setdefault((r.payload_sha256, r.n_bytes), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    pdf = next(r for r in got if r.doc_id == 9)
    assert pdf.feature.endswith(f"content=application/pdf;length={len(PDF)};corrected=true")
    plain = next(r for r in got if r.doc_id == 8)
    assert plain.feature.startswith("audio/wav;format=1;channels=1;rate=8000;bits=8;samples=64;min=0;max=") and plain.feature.endswith("content=text/plain;length=64;corrected=false")


def test_the_standard_library_reads_the_stored_form():
    pay = media.padded("Grüße".encode())
    with wave.open(io.BytesIO(media.to_wav(pay))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, pay)
    assert media.sniff(media.to_wav(b"abc"))[:2] == ("audio/wav", 48)


def test_formats_and_broken_ones():
    good = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF, "application/zip": zipped(), "application/gzip": gzip.compress(b"hello"), "audio/wav": media.to_wav(b"abcd")}
    for kind, data in good.items():
        assert media.sniff(data) == (kind, len(data), [])
        assert media.sniff(b"junk \xfe" + data + b"tail") == ("application/octet-stream", len(data) + 10, [(kind, 6, len(data))])
        assert media.sniff(data[:-3])[0] != kind, kind
    assert media.sniff(b"plain text") == ("text/plain", 10, [])
    assert media.sniff(png()[:20] + b"\x07" + png()[21:])[0] == "application/octet-stream"
    everything = b"\xfe" + b"..".join(good.values())
    assert [k for k, _, _ in media.sniff(everything)[2]] == list(good)


def test_types_are_corrected(spark):
    rows = [(1, 3, "image/png", bytearray(png())), (2, 4, "image/png", bytearray(b"text")), (3, 0, None, None), (4, 5, "text/plain", bytearray(media.to_wav(b"..." + GIF)))]
    df = spark.createDataFrame(rows, "id long, n_bytes long, declared string, media binary")
    got = {r.id: r for r in media.inspected(df).collect()}
    assert [(got[i].type, got[i].corrected) for i in (1, 2, 3, 4)] == [("image/png", False), ("text/plain", True), ("text/plain", True), ("application/octet-stream", True)]
    assert [tuple(c) for c in got[4].carved] == [("image/gif", 3, len(GIF))] and bytes(got[4].payload) == b"..." + GIF


def test_a_declared_column_decides_per_row(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, PDF.decode(), "application/pdf"), (2, PDF.decode(), "text/plain"), (3, "hello " + PDF.decode(), "text/plain"), (4, "x", None)], "doc_id long, text string, kind string")
    got = {r.doc_id: r.feature for r in media.media_columns(df, declared=F.col("kind")).collect()}
    assert got[1].endswith("corrected=false") and got[2].endswith("corrected=true")
    assert f"content=text/plain;length=64;corrected=false;carved=application/pdf@6+{len(PDF)}" in got[3] and got[4].endswith("corrected=true")
    through = {r.id: r.feature for r in media.inspected(media.stored(df, declared=F.col("kind"))).collect()}
    assert through == got


def plain_feature(text, declared="text/plain"):
    """The feature of a text in which PDF files are the only media, by the standard library."""
    pay = media.padded((text or "").encode())
    with wave.open(io.BytesIO(media.to_wav(pay))) as w:
        v = w.readframes(w.getnframes())
        head = f"audio/wav;format=1;channels={w.getnchannels()};rate={w.getframerate()};bits={8 * w.getsampwidth()};samples={w.getnframes()}"
    found, at = [], 0
    while (at := v.find(PDF, at)) >= 0:
        found.append(at)
        at += len(PDF)
    first = found[:1] == [0]
    what, length = ("application/pdf", len(PDF)) if first else ("text/plain", len(v))
    carved = "".join(f";carved=application/pdf@{p}+{len(PDF)}" for p in (found[1:] if first else found))
    return f"{head};min={min(v)};max={max(v)};sum={sum(v)};content={what};length={length};corrected={str(what != declared).lower()}{carved}"


def test_features_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice([PDF.decode(), "RIFF", "PK\x03\x04", "%PDF-", "GIF89a", "é🤣", "plain ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None]
    # A start without a version that is no file still ends the one before it; leave those out.
    texts = [t for t in texts if t is None or "%PDF-" not in t.replace(PDF.decode(), "")]
    got = {r.doc_id: r for r in media.media_columns(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i].feature == plain_feature(t), t
        raw = media.to_wav(media.padded((t or "").encode()))
        assert (got[i].media_bytes, got[i].media_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())


def test_repeated_magic_takes_linear_time():
    import time

    head = png()[:33]
    for unit in (b"PK\x03\x04", b"PK\x05\x06" + b"\0" * 18 + b"PK\x03\x04", b"\x1f\x8b\x08\0", b"%PDF-1.4", b"GIF89a\x01\0\x01\0\0\0\0!\xff\x01", b"\xff\xd8\xff\xda\0\x02", head + struct.pack(">I", 1 << 19) + b"IDAT", b"RIFF\0\0\1\0WAVE", b"RIFF\0\0\0\0AVI "):
        data = unit * (400_000 // len(unit))
        began = time.perf_counter()
        media.sniff(data)
        assert time.perf_counter() - began < 3, unit


def test_empty(spark):
    assert media.media_columns(spark.createDataFrame([], SCHEMA)).collect() == []
