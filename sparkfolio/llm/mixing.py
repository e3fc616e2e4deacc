"""Mixing sources to target weights at exact budgets.

Every document gets a hash-random key.  Within a source the mix takes
documents in the order of their keys until the source's budget of words is
spent, after whole epochs where the budget is more than the source has.  The
cut is found from prefix sums in two steps: over the sums of key ranges, which
are few, then over the rows of the one range in which the budget ends.  The
decision about a row then needs no more than its source's cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import WORD, col, pinned, written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SEED = 17
#: Bits of a key; the rows that a key range has about; the least and most bits that name a range.
KEY_BITS, RANGE_ROWS, RANGE_BITS = 60, 50_000, (10, 20)
#: Sources up to which their cuts are broadcast; beyond it they are joined like any table.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0))


def random_key(doc_id: Column, seed: int = SEED) -> Column:
    """A number of 60 bits that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source.

    Weights repeat over the sources in the order of their code points, null
    last.  A target stops at ``most`` times its source's size and the excess
    goes to the others by weight, until none is above.  That is a level times
    the weight, the same for all sources below their stop.
    """
    ranked = totals.select(
        "*", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).alias("at")
    ).select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") - 1) % len(weights) + 1).alias("w"), "at")
    stop = (F.col("source_size") * most).alias("stop")
    order = Window.orderBy(F.col("stop") / F.col("w"), "at")
    filled = ranked.select("*", stop).select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("all"),
        F.row_number().over(order).alias("n"),
        F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest_w"),
    )
    level = (F.lit(share) * F.col("all") - F.col("full")) / F.col("rest_w")
    fits = F.when(level * F.col("w") <= F.col("stop"), F.struct("n", level.alias("level")))
    chosen = filled.select("*", F.min(fits).over(Window.partitionBy()).alias("c"))
    return chosen.select(
        "source",
        "source_size",
        F.when(F.col("n") >= F.col("c.n"), F.col("c.level") * F.col("w")).otherwise(F.col("stop").cast("double")).alias("target"),
    )


def cuts(narrow: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source of ``narrow(source, size, key)``: its target, whole epochs and the place of the cut.

    Rows before ``(cut_key, cut_size)`` are taken once more than ``epochs``
    times; each row at it adds ``part`` words.
    """
    totals = written(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources", 1)
    rows = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(max(math.ceil(math.log2(max(1, rows / RANGE_ROWS))), RANGE_BITS[0]), RANGE_BITS[1])
    whole = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    goal = written(
        targets(totals.select("source", "source_size"), weights, share, most)
        .select("*", epochs.alias("epochs"))
        .select("*", (whole - F.col("epochs") * F.col("source_size")).alias("rest")),
        "targets",
        1,
    )
    name = lambda df: df.withColumn("s", F.col("source")).drop("source")  # noqa: E731  for null-safe joins
    ranged = narrow.select("*", F.shiftright("key", KEY_BITS - bits).alias("range"))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    open_ = name(goal.where("rest > 0").select("source", "rest"))
    at = sums.join(open_, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "range", "words", "rest", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("before")
    )
    at = at.where("before < rest and before + words >= rest")
    edge = name(written(at.select("source", F.col("range").alias("r"), (F.col("rest") - F.col("before")).alias("left")), "ranges", 1))
    units = (
        ranged.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .groupBy("source", "key", "size", "left")
        .agg(F.count("*").alias("rows"))
    )
    along = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = units.select("*", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(along), F.lit(0)).alias("before"))
    cut = cut.where("before < left and before + size * rows >= left").select(
        F.col("source").alias("s"), F.col("key").alias("cut_key"), F.col("size").alias("cut_size"),
        F.floor((F.col("left") - F.col("before")) / F.col("rows")).cast("long").alias("part"),
    )
    return written(goal.drop("rest").join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "cuts", 1)


def _with_cuts(rows: DataFrame, source: str, cut: DataFrame) -> DataFrame:
    small = cut.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(cut) if small else cut, col(source).eqNullSafe(F.col("cut_source")), "left")


def _before(key: Column, size: Column) -> Column:
    return F.coalesce((key < F.col("cut_key")) | ((key == F.col("cut_key")) & (size < F.col("cut_size"))), F.lit(False))


def _at(key: Column, size: Column) -> Column:
    return F.coalesce((key == F.col("cut_key")) & (size == F.col("cut_size")), F.lit(False))


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        col(id_col).alias("id"), col(source_col).cast("string").alias("source"),
        word_count(col(text_col)).alias("size"), random_key(col(id_col)).alias("key"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per document.

    A null text has size 0 and is taken 0 times; a source without words has
    target 0.  Repeated rows share their place: where the cut falls on several
    equal ones each gives an equal part of what is left, so a source may miss
    its target by fewer words than it has such rows, else by less than one.
    Rows with a null id share one key.  An empty table gives an empty one.
    """
    narrow = written(_narrow(docs, id_col, text_col, source_col), "sizes")
    cut = cuts(narrow, weights, share, most).withColumnRenamed("source", "cut_source")
    key, size = F.col("key"), F.col("size")
    extra = F.when(_before(key, size), size).when(_at(key, size), F.col("part")).otherwise(0)
    return _with_cuts(narrow, "source", cut).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("epochs") * size + extra).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: whole documents, as often as it takes them, columns unchanged.

    The document at the cut comes in whole if at least half its words are
    within the budget, so a source misses its target by half a document at
    most (by half its size for each repeated row there).
    """
    narrow = written(_narrow(docs, id_col, text_col, source_col), "sizes")
    cut = cuts(narrow, weights, share, most).withColumnRenamed("source", "cut_source")
    held = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"), col(source_col).cast("string").alias("source"),
        word_count(col(text_col)).alias("size"), random_key(col(id_col)).alias("key"),
    )
    key, size = F.col("key"), F.col("size")
    more = _before(key, size) | (_at(key, size) & (2 * F.col("part") >= size))
    copies = F.when(pinned(F.lit(True)), (F.col("epochs") + more.cast("int")).cast("int"))
    taken = _with_cuts(held, "source", cut).select("row", copies.alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


ORACLE_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as key
  from documents
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as nth from d group by source
), w as (
  select *, ([3, 1, 2])[((nth - 1) % 3 + 1)::int]::bigint as weight, 2 * source_size as stop from s
), f as (
  select *, (sum(source_size) over ())::bigint as whole,
    row_number() over (order by stop / weight::double, nth) as n,
    coalesce(sum(stop) over (order by stop / weight::double, nth rows between unbounded preceding and 1 preceding), 0)::bigint as filled,
    (sum(weight) over (order by stop / weight::double, nth rows between current row and unbounded following))::bigint as rest_w
  from w
), l as (select *, (1.5::double * whole - filled) / rest_w as level from f),
c as (select min(n) as n from l where level * weight <= stop),
t as (
  select l.source, l.source_size,
    case when l.n >= c.n then (select level from l x where x.n = c.n) * l.weight else l.stop::double end as target
  from l cross join c
), e as (
  select *, case when source_size > 0 then floor(round(target) / source_size)::bigint else 0 end as epochs from t
), u as (
  select source, key, size, count(*) as n from d group by all
), p as (
  select u.*, coalesce(sum(n * size) over (partition by source order by key, size rows between unbounded preceding and 1 preceding), 0)::bigint as before from u
)
select d.doc_id, d.size, e.source_size, e.target,
  (e.epochs * d.size + case
    when p.before + p.n * p.size <= round(e.target)::bigint - e.epochs * e.source_size then d.size
    when p.before < round(e.target)::bigint - e.epochs * e.source_size
      then floor((round(e.target)::bigint - e.epochs * e.source_size - p.before) / p.n)::bigint
    else 0 end)::bigint as taken
from d join e on d.source is not distinct from e.source
join p on d.source is not distinct from p.source and d.key = p.key and d.size = p.size
"""
