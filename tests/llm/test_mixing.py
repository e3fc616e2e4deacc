from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from sparkfolio.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size int, key string, `row` int"


def rows():
    rng = random.Random(8)
    out = []
    for i in range(900):
        source = rng.choice(["hot"] * 5 + ["a", "b", "é", "Z", None])
        out.append((i, rng.choice([" ", "\n"]).join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))), source, 1, "k", 2))
    out += [(1000, "w " * 3000, "huge", 1, "k", 2), (1001, None, "none", 1, "k", 2), (1002, "", "none", 1, "k", 2), (1003, None, "a", 1, "k", 2)]
    return out + out[:3] + [out[0]] * 4 + [(None, "one two", "a", 1, "k", 2)] * 3


def levels(sizes, share=1.5, most=2):
    """Targets by stopping and sharing again, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = total / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            total -= target[s]
        open_ -= over
    return target


def test_budgets(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = mixing.mix(docs).collect()
    assert len(got) == len(data)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in data:
        sizes[r[2]] += size_of(r[1])
    want = levels(sizes)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), size_of(r[1])) for r in data)
    by_id = {r[0]: r[2] for r in data}
    taken, times = defaultdict(int), {}
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        times.setdefault(s, set()).add(r.taken - r.size * (r.taken // r.size) if r.size else 0)
    assert all(abs(taken[s] - want[s]) < 6 for s in sizes)


def test_oracle_gives_the_same(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    documents = pa.Table.from_pandas(docs.select(F.col("doc_id"), "text", "source").toPandas().astype({"doc_id": "Int64"}))  # noqa: F841
    theirs = duckdb.sql(mixing.ORACLE_SQL).fetchall()
    assert sorted(map(str, map(tuple, mixing.mix(docs).collect()))) == sorted(map(str, theirs))


def test_whole_documents(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = max(taken.get(r.doc_id, 0), r.taken / r.size if r.size else 0)
    times, had = defaultdict(int), defaultdict(int)
    for r in got.collect():
        times[r.doc_id] += 1
    for r in docs.collect():
        had[r.doc_id] += 1
    for k, n in had.items():
        if taken[k] not in (0, 1, 2):
            assert times[k] / n in (int(taken[k]), int(taken[k]) + 1)
        elif taken[k]:
            assert times[k] == taken[k] * n


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
