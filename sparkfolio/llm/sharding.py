"""Sharding by vector bin packing of bytes, tokens and rows.

Groups of equal texts are placed whole, each on the shard where the dot
product of its vector with the residual capacity is highest.  Heavy groups, of
which there can be only so many, are placed one after the other on the driver;
all others are dealt by a hash of their text to lanes that are packed side by
side, each into its part of the capacity that the heavy ones left.  A group
larger than a whole shard is cut into as many pieces as there are shards, since
no placing of it could keep them even.

Equal rows are one unit with a count from the start, so neither a repeated id
nor a null one makes a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import col, written
from sparkfolio.llm.mixing import word_count

SHARDS = 16
#: Part of a shard from which a group is heavy: at most 3 * SHARDS / HEAVY groups are.
HEAVY = 1 / 64
#: Groups that one lane packs.
LANE_GROUPS = 50_000
#: Weights of bytes, tokens and rows in the dot product.
BALANCE = (1.0, 1.0, 1.0)
#: Units that are numbered in one task, and rows of a unit that are numbered together.
SLOT_ROWS, UNIT_ROWS = 100_000, 10_000


def pack(vectors: np.ndarray, residual: np.ndarray, balance=BALANCE) -> np.ndarray:
    """The shard of each row of ``vectors``; takes them off ``residual``, the capacity left by shard and part.

    Items go in order of their size in all parts, ties in the order given; among
    equal dot products the first shard is taken.  A share of capacity counts
    alike in each part, so ``vectors`` and ``residual`` are in shares.
    """
    out, weighted = np.zeros(len(vectors), dtype=np.int64), vectors * np.array(balance)
    for i in np.argsort(-vectors.sum(axis=1), kind="stable") if len(vectors) else []:
        out[i] = best = int(np.argmax(residual @ weighted[i]))
        residual[best] -= vectors[i]
    return out


def pack_lane(vectors: np.ndarray, left: np.ndarray, balance=BALANCE) -> np.ndarray:
    """The shards of a lane's groups, into a capacity that has the lane's size and the form of what is ``left``."""
    total = np.maximum(vectors.sum(axis=0), 1e-300)
    free = np.maximum(left, 0)
    whole = free.sum(axis=0)
    form = np.where(whole > 0, free / np.where(whole > 0, whole, 1), 1 / len(left))
    # In shares of a shard's part of the lane, so that a lane packs as the whole would.
    unit = total / len(left)
    return pack(vectors / unit, form * len(left), balance)


def _lanes(groups: DataFrame, lanes: int, left: np.ndarray) -> DataFrame:
    """``text_key, shard`` of light groups ``text_key, b, t, n``."""

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("text_key")
        vectors = np.column_stack([table.column(c).to_numpy() for c in ("b", "t", "n")]).astype(float)
        at = pack_lane(vectors, left)
        return pa.table({"text_key": table.column("text_key"), "shard": pa.array(at, pa.int32())})

    named = groups.select("text_key", "b", "t", "n", F.pmod(F.xxhash64("text_key", F.lit("lane")), F.lit(lanes)).alias("lane"))
    return named.groupBy("lane").applyInArrow(packed, "text_key long, shard int")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per document; the law is ``bytes``.

    Size is the UTF-8 length plus one; a null text is an empty one, and all
    nulls and empty texts are one group.  Slots of a shard run from 0 without
    gaps.  Repeated rows get slots of their own, and where their group is cut
    they are spread over its pieces like others.  Null ids are ids like others.
    ``grown_shard`` is null, as it belongs to another law.  An empty table
    gives an empty one.
    """
    spark, text = docs.sparkSession, F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(
        col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), word_count(text).alias("tokens"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_key"),
    )
    units = written(rows.groupBy("doc_id", "size", "tokens", "text_crc32", "text_key").agg(F.count("*").alias("copies")), "units")
    total = lambda c: F.sum(F.col(c) * F.col("copies"))
    groups = written(units.groupBy("text_key").agg(total("size").alias("b"), total("tokens").alias("t"), F.sum("copies").alias("n")), "groups")
    count, *sums = groups.agg(F.count("*"), F.sum("b"), F.sum("t"), F.sum("n")).first()
    unit = np.array([max(1, x or 0) / shards for x in sums])
    share = F.greatest(*[F.col(c) / float(u) for c, u in zip("btn", unit)])
    heavy = groups.where(share > HEAVY).orderBy("text_key").collect()  # at most 3 * shards / HEAVY
    names = ["doc_id", "size", "text_crc32", "text_key"]
    share_of = [max(np.array(r[1:]) / unit) for r in heavy]
    known = spark.createDataFrame([(r.text_key, 1 if x <= 1 else shards) for r, x in zip(heavy, share_of)], "text_key long, p int")
    # The copies of a unit go round the pieces of its group, from one that its id names.
    cut = units.join(F.broadcast(known), "text_key").select("*", F.explode(F.sequence(F.lit(0), F.least("copies", "p").cast("int") - 1)).alias("j"))
    cut = cut.select(
        *names, "tokens", F.pmod(F.xxhash64("doc_id", F.lit("piece")) + F.col("j"), F.col("p")).cast("int").alias("piece"),
        (F.floor(F.col("copies") / F.col("p")) + (F.col("j") < F.col("copies") % F.col("p")).cast("long")).alias("copies"),
    )
    piece = cut.groupBy("text_key", "piece").agg(total("size").alias("b"), total("tokens").alias("t"), F.sum("copies").alias("n"))
    piece = piece.orderBy("text_key", "piece").collect()  # at most 3 * shards groups are cut
    left = np.ones((shards, 3))
    at = pack(np.array([r[2:] for r in piece], dtype=float).reshape(-1, 3) / unit, left)
    placed = spark.createDataFrame([(r.text_key, r.piece, int(x)) for r, x in zip(piece, at)], "text_key long, piece int, shard int")
    light = _lanes(groups.where(share <= HEAVY), 1 + count // LANE_GROUPS, left)
    parts = cut.join(F.broadcast(placed), ["text_key", "piece"]).select(*names, "shard", "copies")
    parts = parts.unionAll(units.join(light, "text_key").select(*names, "shard", "copies"))
    # Units of many rows are numbered in parts too.
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / UNIT_ROWS)))
    parts = parts.select("*", runs.alias("run")).select(
        *names, "shard", "run", F.least(F.lit(UNIT_ROWS), F.col("copies") - F.col("run") * UNIT_ROWS).alias("copies"),
        F.pmod(F.xxhash64("doc_id", "text_key", "run", F.lit("slot")), F.lit(1 + (sums[2] or 0) // (shards * SLOT_ROWS))).alias("part"),
    )
    parts = written(parts, "parts")
    counts = parts.groupBy("shard", "part").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_key", "size", "run").rowsBetween(Window.unboundedPreceding, -1)
    numbered = parts.select("*", F.coalesce(F.sum("copies").over(within), F.lit(0)).alias("rank")).join(starts, ["shard", "part"])
    first = F.col("start") + F.col("rank")
    return numbered.select("*", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
