"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two link when at most four differ.  Cut into three
segments, at least one segment of such a pair differs in one bit or none, so
both fingerprints share a variant of that segment with one bit blanked out.
Each distinct fingerprint is therefore indexed under its 64 one-wildcard
variants (21 + 21 + 22), an equality on the variant brings candidates together
and a bit count verifies them.

A variant has 20 or 21 free bits, so with N fingerprints about N / 2^20 share
one.  Up to SPLIT of them (N about 10^11) are compared block against block in
tasks of their own, a word operation a pair.  Beyond that, the other two
segments, which differ in four bits or fewer too, are cut into three again, and
a group is dealt by the one-wildcard variants of those: 13 or 14 more bits.

Similarity 0.8 of sets of shingles is far more than four bits (about a seventh
of all), which no cut into segments of a useful length can guarantee.  The wide
form for such links has 256 bits, of which up to WIDE_BITS may differ, and
indexes one-wildcard variants of six short segments, each together with the
least of a hash of the shingles: what makes a key selective is the least hash,
and what splits the documents that share a frequent passage is the segment.
Bits only choose candidates there; each link is then verified on the shingles
themselves, of the texts that have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.common import BROADCAST_PLACES, col, drop_written, located, location, without, written
from sparkfolio.llm.components import stars

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
#: Offset and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Members of one variant that are compared in one task; more are dealt out as pairs of blocks.
BLOCK = 2048
#: Members of one variant that are compared at all; more are dealt by variants of the other segments first.
SPLIT = 1 << 17
#: The wide form: words in a shingle, 64-bit words of a fingerprint, bits that may differ (the share at a similarity
#: of 0.8 is 0.152 of them or 39, with a deviation of 6; at 0.7 it is 49, at 0.5 it is 69), segments that are indexed and their width.
WIDE_SHINGLE, WIDE_WORDS, WIDE_BITS, BANDS, BAND_BITS = 5, 4, 56, 6, 8
#: Similarity of the sets of shingles from which on two texts are near duplicates.
SIMILARITY = 0.8
#: Different shingles of a text that are held against another's; of a text with more, those with the least hashes stand
#: for all. The similarity is exact up to there and has a deviation of 0.006 beyond.
SKETCH = 4096
#: Groups up to this size are compared by shifts over the sorted batch.
SMALL_GROUP = 8
_STEP = 1 << 16
#: Keys from here on are of groups that were dealt once more.
_DEALT = 1 << 28


def _shingle_hashes(text: bytes | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of one UTF-8 text, by up to _STEP of them; none for a text without a word."""
    parts = (text or b"").lower().split()
    n = len(parts)
    if not n:
        return
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        yield np.array([digest(joined, SEED)], dtype=np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=n) + 1)
    starts = np.concatenate(([0], ends[: n - words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    del parts
    for k in range(0, len(starts), _STEP):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + _STEP], stops[k : k + _STEP])], dtype=np.uint64)


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one UTF-8 text; zero if it has no word.

    A-Z are lower-cased, words are split at ASCII white space, shingles count
    with their repeats and a text of fewer words is one shingle.
    """
    votes, total = np.zeros(64, dtype=np.int64), 0
    for h in _shingle_hashes(text, words):
        votes, total = votes + _votes(h), total + len(h)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hashes made from one."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Of the set of five-word shingles: WIDE_WORDS words of majority bits, and the least of BANDS hashes.

    Both are zero for a text without a word.  Repeats of a shingle count once.
    """
    parts = list(_shingle_hashes(text, WIDE_SHINGLE))
    if not parts:
        return np.zeros(WIDE_WORDS, dtype=np.uint64), np.zeros(BANDS, dtype=np.uint64)
    h = np.unique(np.concatenate(parts))
    del parts
    votes, least = np.zeros((WIDE_WORDS, 64), dtype=np.int64), np.full(BANDS, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(h), _STEP):
        some = h[k : k + _STEP]
        for w in range(WIDE_WORDS):
            votes[w] += _votes(_mixed(some, w))
        least = np.minimum(least, [_mixed(some, WIDE_WORDS + b).min() for b in range(BANDS)])
    return np.packbits(2 * votes > len(h), axis=1, bitorder="little").view("<u8").reshape(-1), least


@F.arrow_udf(T.LongType())
def fingerprint_udf(texts: pa.Array) -> pa.Array:
    """Fingerprints as signed 64-bit integers of the same bits."""
    raw = texts.cast(pa.large_binary()).to_pylist()
    return pa.array(np.array([fingerprint(x) for x in raw], dtype=np.uint64).view(np.int64))


_WIDE = T.StructType([T.StructField("fp", T.ArrayType(T.LongType())), T.StructField("least", T.ArrayType(T.LongType()))])


@F.arrow_udf(_WIDE)
def wide_udf(texts: pa.Array) -> pa.Array:
    """The wide form of each text."""
    found = [wide_fingerprint(x) for x in texts.cast(pa.large_binary()).to_pylist()]
    fp = pa.array([x.view(np.int64) for x, _ in found], pa.list_(pa.int64()))
    least = pa.array([x.view(np.int64) for _, x in found], pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([fp, least], ["fp", "least"])


def sketch(text: bytes | None) -> tuple[np.ndarray, int]:
    """The hashes of the set of five-word shingles in order, and the hash up to which they are all there."""
    parts = [np.unique(x.view(np.int64)) for x in _shingle_hashes(text, WIDE_SHINGLE)]
    h = np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64)
    return (h, 2**63 - 1) if len(h) <= SKETCH else (h[:SKETCH], int(h[SKETCH - 1]))


@F.arrow_udf(T.StructType([T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("upto", T.LongType())]))
def sketch_udf(texts: pa.Array) -> pa.Array:
    """The shingles of each text."""
    found = [sketch(x) for x in texts.cast(pa.large_binary()).to_pylist()]
    hashes = pa.array([h for h, _ in found], pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([hashes, pa.array([u for _, u in found], pa.int64())], ["hashes", "upto"])


def variants(fps: DataFrame) -> DataFrame:
    """``(key, fp)``: 64 rows per fingerprint, the key naming variant and segment value."""
    out, v = [], 0
    for offset, width in SEGMENTS:
        part = F.shiftrightunsigned(F.col("fp"), offset).bitwiseAND((1 << width) - 1)
        for bit in range(width):
            kept = part.bitwiseAND(((1 << width) - 1) ^ (1 << bit))
            out.append((kept + F.lit(v << 22)).cast("long"))
            v += 1
    return fps.select(F.explode(F.array(*out)).alias("key"), "fp")


def _sub_segments(segment: int) -> list[list[int]]:
    """The bits of the other two segments, cut into three."""
    bits = [b for k, (offset, width) in enumerate(SEGMENTS) if k != segment for b in range(offset, offset + width)]
    third = -(-len(bits) // 3)
    return [bits[k : k + third] for k in range(0, len(bits), third)]


def _sub_variants(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(key, fp)`` of a large group dealt once more, by the one-wildcard variants of its other segments.

    The new key has the variant's number and value above the old key's bits, so
    two members that differ in four bits or fewer share one of them.
    """
    keys, fps, v = [], [], 0
    starts = np.cumsum([0] + [width for _, width in SEGMENTS])
    for segment in range(len(SEGMENTS)):
        number = key >> 22
        mine = (number >= starts[segment]) & (number < starts[segment + 1])
        if not mine.any():
            continue
        x, old, v = fp[mine], key[mine], 0
        for bits in _sub_segments(segment):
            value = np.zeros(len(x), dtype=np.int64)
            for k, b in enumerate(bits):
                value |= (x >> np.uint64(b) & np.uint64(1)).astype(np.int64) << k
            for k in range(len(bits)):
                keys.append(old | (value & ~(1 << k)) << 28 | np.int64(v) << 44)
                fps.append(x)
                v += 1
    return np.concatenate(keys), np.concatenate(fps)


def _first_variant(x: np.ndarray) -> np.ndarray:
    """The lowest variant that two fingerprints with exclusive-or ``x`` share."""
    best, v = np.full(len(x), 255, dtype=np.int64), 0
    for offset, width in SEGMENTS:
        part = (x >> np.uint64(offset)) & np.uint64((1 << width) - 1)
        n = np.bitwise_count(part)
        bit = np.bitwise_count(part - np.uint64(1)).astype(np.int64)  # of a power of two: its index
        best = np.minimum(best, np.where(n == 0, v, np.where(n == 1, v + bit, 255)))
        v += width
    return best


def _forest(fp: np.ndarray, other: np.ndarray | None = None) -> tuple[list, list]:
    """Links that span what all links among ``fp`` (and ``other``) connect."""
    nodes = fp if other is None else np.concatenate([fp, other])
    a, b, left = [], [], np.arange(len(nodes))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(nodes[left] ^ nodes[at]) <= MAX_BITS
            if near.any():
                found, left = left[near], left[~near]
                a += [nodes[at]] * len(found)
                b += nodes[found].tolist()
                queue += found.tolist()
    return a, b


def _small_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links in groups of equal keys, each in its first shared variant only."""
    a, b, at = [], [], np.arange(len(key))
    for d in range(1, SMALL_GROUP):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + d]
        ok = np.bitwise_count(x) <= MAX_BITS
        ok[ok] = (_first_variant(x[ok]) == (key[at][ok] >> 22)) | (key[at][ok] >= _DEALT)
        a.append(fp[at[ok]])
        b.append(fp[at[ok] + d])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _rows(a=(), b=(), key=None, block=None) -> pa.RecordBatch:
    """A link when ``key`` is null, else a member of a large group and its block."""
    signed = lambda x: np.asarray(x, dtype=np.uint64).view(np.int64)
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(a)), pa.array(signed(b)) if key is None else pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()) if key is None else pa.array(np.full(n, key, dtype=np.int64)), pa.nulls(n, pa.int32()) if key is None else pa.array(np.asarray(block, dtype=np.int32))],
        ["a", "b", "key", "block"],
    )


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each key of a partition sorted by key, in bounded memory."""
    key, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    hot, sent = None, 0  # the large group that is being passed on

    def groups(key, fp):
        edge = np.flatnonzero(np.diff(key)) + 1
        start, stop = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
        large = stop - start > SMALL_GROUP
        for s, e in zip(start[large].tolist(), stop[large].tolist()):
            yield _rows(*_forest(fp[s:e]))
        few = np.repeat((stop - start > 1) & ~large, stop - start)
        a, b = _small_links(key[few], fp[few])
        if len(a):
            yield _rows(a, b)

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if hot is not None:
            n = int(np.searchsorted(key, hot, side="right"))
            if n:
                yield _rows(fp[:n], key=hot, block=(sent + np.arange(n)) // BLOCK)
            sent, key, fp = sent + n, key[n:], fp[n:]
            if not len(key):
                continue
            hot = None
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:
            yield from groups(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
        if len(key) > BLOCK:
            hot, sent = int(key[0]), len(key)
            yield _rows(fp, key=hot, block=np.arange(sent) // BLOCK)
            key, fp = key[:0], fp[:0]
    if len(key):
        yield from groups(key, fp)


def _block_pairs(hot: DataFrame) -> DataFrame:
    """Links within large groups: each pair of blocks is compared in a task of its own."""

    def compare(batches):
        now, held = None, {}

        def done():
            if now is not None:
                i, j = now[1], now[2]
                left = np.concatenate(held.get(i, [np.zeros(0, np.int64)])).view(np.uint64)
                right = None if i == j else np.concatenate(held.get(j, [np.zeros(0, np.int64)])).view(np.uint64)
                yield _rows(*_forest(left, right))

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            ids = np.stack(cols[:3])
            cut = np.flatnonzero((np.diff(ids) != 0).any(axis=0)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), ids.shape[1]]):
                if s == e:
                    continue
                if (this := tuple(ids[:, s].tolist())) != now:
                    yield from done()
                    now, held = this, {}
                for block in np.unique(cols[3][s:e]).tolist():
                    held.setdefault(block, []).append(cols[4][s:e][cols[3][s:e] == block])
        yield from done()

    last = hot.groupBy("key").agg(F.max("block").alias("last"))
    pairs = hot.join(last, "key").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("o"), F.col("block"), F.col("a").alias("fp")
    )
    pairs = pairs.select("key", F.least("o", "block").alias("i"), F.greatest("o", "block").alias("j"), "block", "fp")
    dealt = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(compare, "a bigint, b bigint, key bigint, block int").select("a", "b")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            key, fp = _sub_variants(part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64))], ["key", "fp"])


def _found(index: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, bool]:
    """Links of an index, and the members of its large groups, if there are any."""
    placed = index.repartition("key").sortWithinPartitions("key")
    found = written(placed.mapInArrow(_candidates, "a bigint, b bigint, key bigint, block int"), "links", rows)
    hot = found.where("key is not null")
    return found.where("key is null").select("a", "b"), hot, not hot.isEmpty()


def links(fps: DataFrame, rows: int = 0) -> DataFrame:
    """``(a, b)`` links that connect what all links among the distinct ``fps(fp)`` connect; ``rows``: about how many there are."""
    plain, hot, some = _found(variants(fps), rows)
    if not some:
        return plain
    size = hot.groupBy("key").agg(F.max("block").alias("last"))
    vast = size.where(F.col("last") >= SPLIT // BLOCK)
    if not vast.isEmpty():
        members = hot.join(vast, "key", "left_semi").select("key", F.col("a").alias("fp"))
        hot = hot.join(vast, "key", "left_anti")
        more, left, some = _found(members.mapInArrow(_dealt, "key bigint, fp bigint"), rows)
        plain = plain.unionAll(more).unionAll(_block_pairs(left)) if some else plain.unionAll(more)
    return plain.unionAll(_block_pairs(hot))


def classes(fingerprints: DataFrame) -> DataFrame:
    """``(fp, root, first_id)`` per distinct fingerprint of ``fingerprints(id, fp)``.

    ``root`` names the class, ``first_id`` is the smallest id in it.
    """
    groups = written(fingerprints.groupBy("fp").agg(F.min("id").alias("own_id")), "fps", fingerprints.count())
    rows = groups.count()
    star = stars(links(groups.select("fp"), rows), rows)
    member = star.select(F.col("node").alias("fp"), "root").unionAll(
        star.select(F.col("root").alias("fp"), "root").distinct()
    )
    linked = groups.join(member, "fp")
    # A table of its own: the join by root is then a plain one too.
    least = written(linked.groupBy("root").agg(F.min("own_id").alias("reached")), "reached", rows)
    reach = linked.join(least, "root").select("fp", "root", "reached")
    named = groups.join(reach, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("reached", "own_id").alias("first_id")
    )
    # As a table of its own, so that joining it to documents is a plain join, whose skewed keys Spark can split.
    return written(named, "classes", rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Texts link at four or fewer differing bits; a component's id is the
    smallest document id in it.  Null and empty texts and texts of white space
    have fingerprint zero and link like any other.  Equal fingerprints are one
    node, so copies cost no pairs.  Repeated rows come back repeated; a null id
    is never the smallest.  An empty table gives an empty one.
    """
    narrow = written(docs.select(col(id_col).alias("id"), fingerprint_udf(col(text_col)).alias("fp")), "fingerprints")
    return narrow.join(classes(narrow), "fp").select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first_id").alias("component_id"),
    )


def _wide_forest(node: np.ndarray, fp: np.ndarray) -> tuple[list, list]:
    """Links that span what all links within one group connect, of as few differing bits as can be.

    A link that verification refuses is then the closest there was between the
    two parts it joins, so that a pair of alike texts is not lost to a third
    one that is a little like both.
    """
    a, b, at = [], [], 0
    left = np.arange(1, len(node))
    bits, via = np.full(len(left), 64 * WIDE_WORDS + 1), np.zeros(len(left), dtype=np.int64)
    while len(left):
        now = np.bitwise_count(fp[left] ^ fp[at]).sum(axis=1)
        closer = now < bits
        bits[closer], via[closer] = now[closer], at
        k = int(bits.argmin())
        at = int(left[k])
        if bits[k] <= WIDE_BITS:
            a.append(node[via[k]])
            b.append(node[at])
        for x in (left, bits, via):
            x[k] = x[-1]
        left, bits, via = left[:-1], bits[:-1], via[:-1]
    return a, b


def _words(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WIDE_WORDS)


_FOUND = "a bigint, b bigint, key bigint, block int, fp array<bigint>"


def _wide_rows(a=(), b=(), key=None, block=None, fp=None) -> pa.RecordBatch:
    """A link when ``key`` is null, else a member of a large group, its block and its fingerprint."""
    n = len(a)
    null = lambda t: pa.nulls(n, t)
    longs = lambda x: pa.array(np.asarray(x, dtype=np.int64))
    rest = [longs(b), null(pa.int64()), null(pa.int32()), null(pa.list_(pa.int64()))] if key is None else [
        null(pa.int64()), longs(np.full(n, key)), pa.array(np.asarray(block, dtype=np.int32)), pa.array(list(fp.view(np.int64)), pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays([longs(a), *rest], ["a", "b", "key", "block", "fp"])


def _wide_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each key of a partition sorted by key; groups of more than BLOCK members are passed on in blocks."""
    now, sent = None, 0
    node, fp = np.zeros(0, np.int64), np.zeros((0, WIDE_WORDS), np.uint64)

    def ended():
        if sent:
            yield _wide_rows(node, key=now, block=(sent + np.arange(len(node))) // BLOCK, fp=fp)
        elif len(node) > 1:
            a, b = _wide_forest(node, fp)
            if a:
                yield _wide_rows(a, b)

    for batch in batches:
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        words = _words(batch.column(2))
        cut = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
        for s, e in zip(cut, cut[1:]):
            if keys[s] != now:
                yield from ended()
                now, sent, node, fp = keys[s], 0, node[:0], fp[:0]
            node, fp = np.concatenate([node, nodes[s:e]]), np.concatenate([fp, words[s:e]])
            if len(node) > BLOCK:
                yield _wide_rows(node, key=now, block=(sent + np.arange(len(node))) // BLOCK, fp=fp)
                sent, node, fp = sent + len(node), node[:0], fp[:0]
    yield from ended()


def _wide_block_pairs(hot: DataFrame) -> DataFrame:
    """Links within large groups: each two blocks of one are compared in a task of their own."""

    def compare(batches):
        now, nodes, words = None, [], []

        def done():
            if now is not None:
                a, b = _wide_forest(np.concatenate(nodes), np.concatenate(words))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            ids = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cut = [0, *(np.flatnonzero((np.diff(ids) != 0).any(axis=0)) + 1).tolist(), ids.shape[1]] if ids.shape[1] else []
            node, fp = batch.column(3).to_numpy(), _words(batch.column(4))
            for s, e in zip(cut, cut[1:]):
                if (this := tuple(ids[:, s].tolist())) != now:
                    yield from done()
                    now, nodes, words = this, [], []
                nodes.append(node[s:e])
                words.append(fp[s:e])
        yield from done()

    last = hot.groupBy("key").agg(F.max("block").alias("last"))
    pairs = hot.join(last, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("o"), "block", F.col("a").alias("node"), "fp", "last")
    pairs = pairs.where("o <> block or last = 0")
    pairs = pairs.select("key", F.least("o", "block").alias("i"), F.greatest("o", "block").alias("j"), "node", "fp")
    return pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a bigint, b bigint")


def wide_variants(nodes: DataFrame) -> DataFrame:
    """``(key, node, fp)``: BANDS times BAND_BITS rows per ``nodes(node, fp, least)``."""
    out = []
    # A segment lies within one 64-bit word, so that its bits are a shift away.
    per = 64 // BAND_BITS
    for band in range(BANDS):
        part = F.shiftrightunsigned(F.col("fp")[band // per], BAND_BITS * (band % per)).bitwiseAND((1 << BAND_BITS) - 1)
        for bit in range(BAND_BITS):
            kept = part.bitwiseAND(((1 << BAND_BITS) - 1) ^ (1 << bit))
            out.append(F.xxhash64(F.col("least")[band], kept, F.lit(band * BAND_BITS + bit)))
    return nodes.select(F.explode(F.array(*out)).alias("key"), "node", "fp")


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The ``pairs(a, b)`` of nodes whose sets of shingles have a similarity of SIMILARITY or more.

    Only texts with a candidate are read again, where they lie; what is moved
    is their hashes, SKETCH a text at most.
    """
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    places = written(nodes.join(ends, "node").select("node", "at.file", "at.row"), "places")
    file, row = location(docs)
    texts = docs.select(file.alias("file"), row.alias("row"), col(text_col).alias("text"))
    few = places.count() <= BROADCAST_PLACES
    texts = texts.join(F.broadcast(places) if few else places, ["file", "row"])
    sets = written(texts.select("node", sketch_udf("text").alias("s")), "shingles")
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("s").alias(f"s_{end}")), end)
    upto = F.least("s_a.upto", "s_b.upto")
    x, y = (F.filter(f"s_{end}.hashes", lambda h: h <= upto) for end in ("a", "b"))
    sized = pairs.select("a", "b", F.size(x).alias("m"), F.size(y).alias("n"), F.size(F.array_intersect(x, y)).alias("both"))
    near = F.col("both") >= F.lit(SIMILARITY) * (F.col("m") + F.col("n") - F.col("both"))
    return written(sized.where(near).select("a", "b"), "alike")


def wide_classes(narrow: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """``(fp, root)`` per distinct wide fingerprint of ``narrow(file, row, fp, least)``; ``root`` names its class."""
    nodes = narrow.groupBy("fp").agg(F.min("least").alias("least"), F.min(F.struct("file", "row")).alias("at"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "fp", "least", "at"), "nodes")
    rows = nodes.count()
    index = wide_variants(nodes).repartition("key").sortWithinPartitions("key")
    found = written(index.mapInArrow(_wide_candidates, _FOUND), "links", rows)
    hot = found.where("key is not null")
    plain = found.where("key is null").select("a", "b")
    pairs = plain if hot.isEmpty() else plain.unionAll(_wide_block_pairs(hot))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    star = stars(alike(written(pairs, "pairs", rows), nodes, docs, text_col), rows)
    out = nodes.join(star, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    out = written(out, "classes", rows)
    drop_written(found)
    drop_written(star)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each class of near duplicates left, columns unchanged.

    Texts link if the wide form makes them candidates and their sets of
    five-word shingles have a similarity of 0.8 or more.  The row with the smallest id stays (a null id is
    last; of equal ids, and of rows equal in every column, the one that lies
    first).  Rows are told apart by their place, never by what is in them, so
    any column types will do; texts are read where they lie and not shuffled
    unless more than BROADCAST_PLACES rows have a candidate or go.  An empty table gives an empty one.
    """
    docs = located(docs)
    file, row = location(docs)
    wide = wide_udf(col(text_col))
    narrow = docs.select(col(id_col).alias("id"), file.alias("file"), row.alias("row"), wide.alias("w"))
    narrow = written(narrow.select("id", "file", "row", "w.fp", "w.least"), "fingerprints")
    named = written(narrow.join(wide_classes(narrow, docs, text_col), "fp").select("id", "file", "row", "root"), "members")
    place = F.struct(F.col("id").isNull().alias("late"), "id", "file", "row")
    best = named.groupBy("root").agg(F.min(place).alias("best"))
    gone = named.join(best, "root").where(place != F.col("best")).select("file", "row")
    return without(docs, written(gone, "gone"))
