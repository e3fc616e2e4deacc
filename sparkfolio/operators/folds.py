"""Folds over the rows of a group that a page or a table bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type


def folded(rows: DataFrame, key: list[str], columns: list[str], fold: Callable[[list[dict]], list[dict]], result: str) -> DataFrame:
    """``key`` and the columns ``result`` (as in DDL): what ``fold`` makes of each group's ``columns``, sorted in their order.

    Groups reach Python many at a time in Arrow batches, not one frame each.
    """
    kind = ST.ArrayType(ST.StructType.fromDDL(result))
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def deal(groups: pa.Array) -> pa.Array:
        return pa.array([fold(g) for g in groups.to_pylist()], arrow)

    listed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__rows"))
    return listed.select(*key, F.inline(deal("__rows")))


#: Rows that a fold over batches gets at least, unless there are no more; and that it gives at most at once.
BATCH_ROWS = 32_768


def _changes(keys: list[pa.Array]) -> np.ndarray:
    """Whether a row's key is another than that of the row before."""
    out = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        a, b = k[1:], k[:-1]
        out |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return out


def batch_folded(rows: DataFrame, key: list[str], order: list[str], columns: dict[str, str | Column], fold: Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], result: str) -> DataFrame:
    """``key`` and the columns ``result`` (as in DDL): what ``fold`` makes of whole groups, many at a time.

    ``fold`` gets their ``columns`` as one batch in the given order and where
    each group begins, and returns the place of the row that each row out is
    taken from and the columns of ``result`` that are not taken from there.
    Rows go in and out singly, so memory follows the largest group, not how
    many groups there are.  ``key`` columns are no arrays or structs.
    """
    kind = ST.StructType([*(rows.schema[k] for k in key), *ST.StructType.fromDDL(result)])
    n, schema = len(key), to_arrow_schema(kind)

    def made(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.concat_batches(pieces)
        starts = np.flatnonzero(np.concatenate([[True], _changes(whole.columns[:n])]))
        taken, new = fold(whole, starts)
        for at in range(0, len(taken), BATCH_ROWS):
            part = pa.array(taken[at : at + BATCH_ROWS])
            arrays = [pa.array(new[f.name][at : at + BATCH_ROWS]) if f.name in new else whole.column(f.name).take(part) for f in schema]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if sum(b.num_rows for b in held) + batch.num_rows >= BATCH_ROWS:
                both = pa.concat_batches([*(b.slice(b.num_rows - 1) for b in held[-1:]), batch]) if held else batch
                new = np.flatnonzero(_changes(both.columns[:n])) + (0 if held else 1)
                if len(new):
                    cut = int(new[-1])
                    yield from made([*held, batch.slice(0, cut)])
                    held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield from made(held)

    ordered = rows.repartition(*key).sortWithinPartitions(*key, *order)
    return ordered.select(*key, *(F.col(c).alias(name) if isinstance(c, str) else c.alias(name) for name, c in columns.items())).mapInArrow(run, kind)
