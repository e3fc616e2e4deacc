"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import drop_written, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _round(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step; ``a > b`` in all edges."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame, rows: int = 0) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)`` but the roots themselves.

    Alternates large-star and small-star steps until the edges no longer
    change; that takes about the logarithm of the longest path in rounds. Each
    round is a table in the shared folder.  ``rows`` is how many edges there
    are about.  Self-loops are ignored, repeated
    edges count once and an empty table gives an empty one.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows
    )
    state = _state(now)
    while state[0]:
        after = written(_round(now), "edges", state[0])
        drop_written(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
