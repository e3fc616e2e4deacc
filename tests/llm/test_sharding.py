from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np

from sparkfolio.llm import sharding

SCHEMA = "doc_id bigint, text string, shard int, item int, part string"


def rows(n=4000):
    rng = random.Random(4)
    texts = ["x" * rng.randint(0, 400) + " word" * rng.randint(0, 60) for _ in range(n)]
    texts += ["the copied text " * 9] * (n // 2) + [None, "", None, "ä" * 50]
    return [(i, t, 1, 2, "p") for i, t in enumerate(texts)] + [(5, texts[5], 1, 2, "p"), (None, "no id", 1, 2, "p")]


def test_law_slots_and_groups(spark):
    data = rows()
    got = sharding.shard(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t, *_ in data)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    load, slots = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(16))
    assert max(load.values()) < 1.03 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    copied = zlib.crc32(("the copied text " * 9).encode())
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for crc, s in where.items() if crc != copied) and len(where[copied]) > 4


def plain_pack(vectors, free):
    """The greedy choice as a plain loop."""
    out = [None] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: -float(np.array(vectors[i]).sum())):
        score = [sum(f * v * w for f, v, w in zip(free[s], vectors[i], sharding.BALANCE)) for s in range(len(free))]
        out[i] = best = max(range(len(free)), key=lambda s: (round(score[s], 12), -s))
        free[best] = [f - v for f, v in zip(free[best], vectors[i])]
    return out


def test_greedy_choice_against_a_plain_loop():
    rng = np.random.default_rng(1)
    vectors = rng.random((300, 3)) / 20
    assert sharding.pack(vectors, np.ones((7, 3))).tolist() == plain_pack(vectors.tolist(), [[1.0] * 3 for _ in range(7)])


def test_every_light_group_is_placed_by_its_vector(spark):
    """One lane and no heavy group: the whole query is one greedy packing."""
    rng = random.Random(8)
    texts = [f"t{i} " + " ".join("w" * rng.randint(1, 12) for _ in range(rng.randint(1, 4))) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame([(i, t, 1, 2, "p") for i, t in enumerate(texts)], SCHEMA).repartition(3)).collect()
    from pyspark.sql import functions as F

    keys = {r.text: r.k for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text").alias("k")).collect()}
    order = sorted(range(len(texts)), key=lambda i: keys[texts[i]])
    vectors = [(len(texts[i]) + 1, len(texts[i].split()), 1) for i in order]
    shard, shares = {r.doc_id: r.shard for r in got}, np.array(vectors, dtype=float)
    shares /= shares.sum(axis=0) / 16
    free = np.ones((16, 3))
    for i in np.argsort(-shares.sum(axis=1), kind="stable").tolist():
        score, at = free @ (shares[i] * np.array(sharding.BALANCE)), shard[order[i]]
        assert score[at] >= score.max() - 1e-12
        free[at] -= shares[i]


def spread(rows, key):
    load = defaultdict(int)
    for r in rows:
        load[r.shard] += key(r)
    assert set(load) == set(range(16))
    return max(load.values()) / min(load.values())


def test_bytes_tokens_and_rows_are_even(spark):
    data = rows(6000)
    tokens = {(str(i), zlib.crc32((t or "").encode())): len((t or "").split()) for i, t, *_ in data}
    got = sharding.shard(spark.createDataFrame(data, SCHEMA)).collect()
    assert spread(got, lambda r: r.size) < 1.03 and spread(got, lambda r: 1) < 1.1
    assert spread(got, lambda r: tokens[str(r.doc_id), r.text_crc32]) < 1.1


def test_null_and_repeated_ids_stay_even(spark, monkeypatch):
    """1,500 copies without an id, or with one and the same, among 1,500 other documents."""
    monkeypatch.setattr(sharding, "UNIT_ROWS", 100)
    other = [(i, f"text number {i} " + "x" * (i % 90), 1, 2, "p") for i in range(1500)]
    for one in (None, 7):
        data = [(one, "the copied text " * 5, 1, 2, "p")] * 1500 + other
        got = sharding.shard(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
        assert len(got) == 3000 and spread(got, lambda r: r.size) < 1.05 and spread(got, lambda r: 1) < 1.2
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_lanes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LANE_GROUPS", 300)
    got = sharding.shard(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert spread(got, lambda r: r.size) < 1.05


def test_reruns_agree_and_large_shards_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    df = spark.createDataFrame(rows(800), SCHEMA)
    one = sharding.shard(df).collect()
    assert sorted(map(str, one)) == sorted(map(str, sharding.shard(df.repartition(7)).collect()))
    slots = defaultdict(list)
    for r in one:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).collect() == []
