from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkfolio.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, root string, row_hash int"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(fps)):
        for y in range(x):
            if (fps[x][1] ^ fps[y][1]).bit_count() <= 4:
                parent[root(x)] = root(y)
    out = []
    for x in range(len(fps)):
        ids = [fps[y][0] for y in range(len(fps)) if root(y) == root(x) and fps[y][0] is not None]
        out.append((fps[x][0], f"{fps[x][1]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "Ärger", "don't", "x", "omega", "pi", "rho", "tau"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 200))) for _ in range(40)]
    for t in texts[:25]:
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += texts[:5] + [None, "", " \n\t", "one", "ONE", "one two three", " ", "one\x0btwo\x1cthree four five", "long " * 70000]
    return [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(3, "one"), (3, "one"), (None, "orphan text of five words"), (3, texts[0])]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "f", "r", 1) for i, t in rows], SCHEMA).repartition(5)
    got = sorted([tuple(r) for r in simhash.near_duplicates(docs).collect()], key=str)
    assert got == plain_components(rows)


def test_links_keep_every_component(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 60, 300])):
            base_or_walk = base
            for _ in range(rng.randint(0, 4)):
                base_or_walk ^= 1 << rng.randrange(64)
            fps.add(base_or_walk)
            if rng.random() < 0.1:
                base = base_or_walk
    fps = sorted(fps)
    a = np.array(fps, dtype=np.uint64)
    labels = np.arange(len(a))
    while True:
        new = np.array([labels[np.bitwise_count(a ^ x) <= 4].min() for x in a])
        new = np.minimum(new, labels)
        if (new == labels).all():
            break
        labels = new
    old = simhash.BLOCK, simhash.SMALL_GROUP
    df = spark.createDataFrame([(i, int(np.uint64(x).view(np.int64))) for i, x in enumerate(fps)], "id long, fp long")
    got = {r.fp: r.first_id for r in simhash.classes(df).collect()}
    assert [got[int(np.uint64(x).view(np.int64))] for x in fps] == labels.tolist()
    assert old == (simhash.BLOCK, simhash.SMALL_GROUP)


def test_large_groups_are_dealt_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    near = {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)} | {base}
    fps = [int(np.uint64(x).view(np.int64)) for x in sorted(near)]
    batches = []
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), 7, np.int32)), pa.array(fps, pa.int64())], ["key", "fp"])
    monkeypatch.setattr(simhash, "BLOCK", 256)
    for out in simhash._candidates(iter([batch.slice(0, 900), batch.slice(900)])):
        batches.append(out)
    hot = spark.createDataFrame(pa.Table.from_batches(batches).to_pandas().astype({"a": "int64", "key": "int32", "block": "int32"})[["a", "key", "block"]])
    assert hot.count() == len(fps) and hot.agg(F.max("block")).first()[0] == (len(fps) - 1) // 256
    monkeypatch.undo()
    pairs = simhash._block_pairs(hot).collect()
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in pairs:
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4
        parent[root(r.a)] = root(r.b)
    assert len({root(x) for x in fps}) == 1
    assert len(pairs) < 12 * len(fps)


def test_vast_groups_are_dealt_once_more(spark, monkeypatch):
    """Every link of a group is found by the variants of the other segments."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 3000:
        x = rng.choice(sorted(fps)[-50:]) if rng.random() < 0.5 else base ^ (rng.getrandbits(43) << 21)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    monkeypatch.setattr(simhash, "BLOCK", 32)
    monkeypatch.setattr(simhash, "SPLIT", 64)
    df = spark.createDataFrame([(i, int(np.uint64(x).view(np.int64))) for i, x in enumerate(sorted(fps))], "id long, fp long")
    got = {r.fp: r.first_id for r in simhash.classes(df).collect()}
    a = np.array(sorted(fps), dtype=np.uint64)
    labels = np.arange(len(a))
    while True:
        new = np.minimum(np.array([labels[np.bitwise_count(a ^ x) <= 4].min() for x in a]), labels)
        if (new == labels).all():
            break
        labels = new
    assert [got[int(x.view(np.int64))] for x in a] == labels.tolist()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_wide(text):
    """The wide fingerprint, a number and a bit at a time."""
    m = 2**64 - 1
    hs, out = [xxhash.xxh64_intdigest(g.encode(), 42) for g in shingles(text)], []
    for k in range(4):
        mixed = []
        for h in hs:
            x = (h + 0x9E3779B97F4A7C15 * (k + 1)) & m
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
            mixed.append(x ^ (x >> 31))
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)))
    return out


def near_corpus():
    """Texts, and copies of them in which some words are changed, dropped or added."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(800)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 300))) for _ in range(150)]
    texts += [" ".join(rng.choice(vocab) for _ in range(150)) + " " + passage for _ in range(60)]
    for t in texts[:120]:
        for _ in range(2):
            w = t.split()
            for _ in range(max(1, len(w) // rng.choice([30, 60, 100]))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    return texts + [texts[0]] * 3 + [None, "", " ", "one", "one two three", "long " * 30000]


def test_drop_keeps_one_row_of_each_class(spark):
    texts = near_corpus()
    rows = [(i * 7 % 1000, t, "f", {"k": i % 2}, 1) for i, t in enumerate(texts)] + [(None, texts[5], None, {"k": 1}, None), (3000, "orphan", None, None, 2), (3000, "orphan", None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, file string, row map<string,int>, n int").repartition(3)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    kept = {r.doc_id for r in left.collect()}
    sets = [shingles(t) for _, t, *_ in rows]
    gone = [i for i, r in enumerate(rows) if r[0] not in kept]
    # Nothing goes without a text that is 0.8 or more like it, and next to no such pair keeps both.
    assert all(max(jaccard(sets[i], sets[j]) for j in range(len(rows)) if j != i) >= 0.8 for i in gone)
    assert None not in kept and 3000 in kept and left.where("doc_id = 3000").count() == 1
    pairs = [(i, j, jaccard(sets[i], sets[j])) for i in range(len(rows)) for j in range(i)]
    similar = [(i, j, x) for i, j, x in pairs if x >= 0.8]
    both = [x for i, j, x in similar if rows[i][0] in kept and rows[j][0] in kept and i != j and rows[i][0] != rows[j][0]]
    assert len(similar) > 150 and len(both) <= 0.02 * len(similar) and all(x < 0.85 for x in both)


def test_long_texts_by_their_least_hashes(spark, monkeypatch):
    """Texts of more shingles than are held against each other, on either side of the limit."""
    rng = random.Random(8)
    monkeypatch.setattr(simhash, "SKETCH", 700)
    base = [f"w{rng.randrange(10**6)}" for _ in range(9000)]
    few, many = list(base), list(base)
    for k in range(0, 9000, 180):
        few[k] = f"few{k}"
    for k in range(0, 9000, 18):
        many[k] = f"many{k}"
    texts = [" ".join(x) for x in (base, few, many, base[:8900], base[:4000])]
    hashes, upto = simhash.sketch(texts[0].encode())
    assert len(hashes) == 700 and upto == hashes[-1] and simhash.sketch(None)[1] == 2**63 - 1
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [0, 2, 4]


def test_wide_fingerprints():
    for text in near_corpus()[::20] + ["", "One two\tTHREE", "one two three"]:
        assert simhash.wide_fingerprint((text or "").encode())[0].tolist() == plain_wide(text)


def test_forest_takes_the_closest_links():
    zero = np.zeros(simhash.WIDE_WORDS, dtype=np.uint64)
    fp = np.array([zero, zero, zero, zero])
    fp[1, 0], fp[2, 0], fp[3] = 2**40 - 1, 2**42 - 1, 2**64 - 1
    assert [(int(a), int(b)) for a, b in zip(*simhash._wide_forest(np.array([7, 8, 9, 10]), fp))] == [(7, 8), (8, 9)]


def test_wide_blocks_lose_nothing(spark, monkeypatch):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    base = [rng.choice(vocab) for _ in range(200)]
    texts = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()] == [0]


def test_documents_of_a_file_stay_where_they_are(spark, tmp_path):
    rows = [(i, f"text {i % 30} of some words that are all alike", None if i % 2 else "s") for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert simhash.located(docs) is docs and simhash.located(docs.where("doc_id > 3")) is not docs
    left = simhash.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in left.collect()) == list(range(30))
    assert "Exchange hashpartitioning(text" not in left._jdf.queryExecution().toString()


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.drop_near_duplicates(docs).collect() == []
