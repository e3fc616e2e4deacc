"""Placing text on pages as geometry: fitting, vertical rhythm, continuation.

Widths come from an estimator, not from a font: a class of characters has an
advance.  A page's items are few and depend on those above, so that a page is
folded in one call.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_type

from sparkfolio.functions import text as X
from sparkfolio.thresholds import T

#: Advance of a character as part of the font size: wide scripts, and all others.
WIDE, NARROW = 1.0, 0.5


def text_width(text: Column, size: Column | float) -> Column:
    """Estimated width of a text in one line."""
    wide = X.count(text, X.CJK_WIDE)
    return (wide * WIDE + (F.length(text) - wide) * NARROW) * size


def line_count(text: Column, size: Column | float, width: Column | float) -> Column:
    return F.greatest(F.lit(1), F.ceil(text_width(text, size) / width)).cast("int")


def fitted_size(text: Column, width: Column, height: Column, desired: float, least: float, step: float = 0.25) -> Column:
    """The largest size from ``desired`` down to ``least`` at which the text fits the box; null if none does."""
    sizes = [desired - step * k for k in range(int((desired - least) / step) + 1)]
    out = F.lit(None).cast("double")
    for s in reversed(sizes):
        out = F.when(line_count(text, s, width) * s * T.line_height <= height, s).otherwise(out)
    return out


def font_ladder(height: Column, steps: int = 6, factor: float = 0.78) -> Column:
    """Font sizes to try for a line of a height: each the factor of the one before."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.round(height * F.pow(F.lit(factor), k), 4))


def stacked(items: list[tuple[float, float]], top: float, bottom: float, obstacles: list[tuple[float, float]]) -> list[float | None]:
    """Tops of items ``(wanted top, height)`` one under another; None for those that are put off to a later page.

    The gap is the preferred one if all fit with it, else as much as fits down
    to the least one; with that, items are given up from the end until the
    others fit.  An item that would meet an obstacle goes under it.
    """

    def place(gap: float, n: int) -> list[float] | None:
        out, y = [], top
        for wanted, height in items[:n]:
            y = max(y, min(wanted, bottom) if gap == T.rhythm_gap else y)
            for a, b in sorted(obstacles):
                if y < b and a < y + height:
                    y = b + T.rhythm_least_gap
            if y + height > bottom + 1e-9:
                return None
            out.append(y)
            y += height + gap
        return out

    for n in range(len(items), -1, -1):
        gap = T.rhythm_gap
        while gap >= T.rhythm_least_gap - 1e-9:
            if (found := place(gap, n)) is not None:
                return [*found, *[None] * (len(items) - n)]
            gap -= 1.125
    return [None] * len(items)


@F.arrow_udf(ST.ArrayType(ST.DoubleType()))
def stacked_udf(items: pa.Array, top: pa.Array, bottom: pa.Array, obstacles: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (items, top, bottom, obstacles)))
    return pa.array([stacked(i or [], t, b, o or []) for i, t, b, o in rows], pa.list_(pa.float64()))


def prefix_that_fits(words: list[str], width: float, height: float, size: float = T.body_font) -> int:
    """How many words fit a box, by halving."""
    advance = lambda w: sum(WIDE if ord(c) >= 0x3000 else NARROW for c in w) * size
    rows = int(height / (size * T.line_height) + 1e-9)

    def fits(n: int) -> bool:
        used, line = 1, 0.0
        for w in words[:n]:
            a = advance(w)
            if line and line + NARROW * size + a > width:
                used, line = used + 1, 0.0
            line += a + (NARROW * size if line else 0.0)
            used += max(0, math.ceil(line / width) - 1) if line > width else 0
            line = line % width if line > width else line
        return used <= rows

    low, high = 0, len(words)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if fits(mid) else (low, mid - 1)
    return low


def continued(texts: list[str], width: float, height: float, first_height: float, gap: float = T.rhythm_gap, size: float = T.body_font) -> list[tuple[int, int, str]]:
    """``(page, text number, piece)``: a text stays whole if a fresh page holds it, else it is cut where it must be."""
    out, page, left = [], 0, first_height
    line = size * T.line_height
    for i, text in enumerate(texts):
        words = text.split(" ")
        while words:
            n = prefix_that_fits(words, width, left, size)
            if n < len(words) and left < height and prefix_that_fits(words, width, height, size) == len(words):
                page, left = page + 1, height
                continue
            if n == 0 and left < height:
                page, left = page + 1, height
                continue
            n = max(n, 1)
            piece, words = " ".join(words[:n]), words[n:]
            out.append((page, i, piece))
            used = math.ceil(sum(NARROW if ord(c) < 0x3000 else WIDE for c in piece) * size / width) * line
            left -= used + gap
            if words:
                page, left = page + 1, height
    return out


_PIECES = ST.ArrayType(ST.StructType([ST.StructField("page", ST.IntegerType()), ST.StructField("item", ST.IntegerType()), ST.StructField("piece", ST.StringType())]))


@F.arrow_udf(_PIECES)
def continued_udf(texts: pa.Array, width: pa.Array, height: pa.Array, first_height: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (texts, width, height, first_height)))
    found = [[dict(zip(("page", "item", "piece"), p)) for p in continued(t or [], *sizes)] for t, *sizes in rows]
    return pa.array(found, to_arrow_type(_PIECES))
