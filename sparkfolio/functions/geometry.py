"""Box algebra as columns.

A box is ``struct<x0, y0, x1, y1>`` of doubles; a box that is not finite or
has no extent is null, and whatever is computed from it is null too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def pair(width: Column, height: Column) -> Column:
    """``struct<width, height>`` if both are finite and positive, else null."""
    w, h = width.cast("double"), height.cast("double")
    return F.when(_finite(w) & _finite(h) & (w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    a, b, c, d = (v.cast("double") for v in (x0, y0, x1, y1))
    ok = _finite(a) & _finite(b) & _finite(c) & _finite(d) & (c > a) & (d > b)
    return F.when(ok, F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")))


def polygon_box(points: Column) -> Column:
    """The box around ``array<array<double>>`` points."""
    x, y = F.transform(points, lambda p: F.get(p, 0)), F.transform(points, lambda p: F.get(p, 1))
    return F.when(F.size(points) > 1, box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def right_angle(angle: Column) -> Column:
    """The angle within 0..359 if it is a multiple of 90, else null."""
    a = F.pmod(angle.cast("int"), F.lit(360))
    return F.when(a % 90 == 0, a)


def clockwise(angle: Column) -> Column:
    """A counter-clockwise angle as a clockwise one."""
    return F.pmod(-angle, F.lit(360))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def overlap_x(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))


def overlap_y(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def shared(a: Column, b: Column) -> Column:
    """Area of the intersection."""
    return overlap_x(a, b) * overlap_y(a, b)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    return shared(a, b) / F.least(area(a), area(b))


def overlap_of(a: Column, b: Column) -> Column:
    """Part of ``a`` that ``b`` covers."""
    return shared(a, b) / area(a)


def vertical_ratio(a: Column, b: Column) -> Column:
    """Shared height as part of the smaller height."""
    return overlap_y(a, b) / F.least(height(a), height(b))


def horizontal_ratio(a: Column, b: Column) -> Column:
    return overlap_x(a, b) / F.least(width(a), width(b))


def center_in(a: Column, b: Column, slack: float = 0.0) -> Column:
    """Whether the centre of ``a`` lies in ``b``."""
    x, y = center_x(a), center_y(a)
    return (x >= b["x0"] - slack) & (x <= b["x1"] + slack) & (y >= b["y0"] - slack) & (y <= b["y1"] + slack)


def union(b: Column) -> Column:
    """Aggregate: the box around all boxes of a group."""
    return box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"]))


def to_visual(b: Column, page: Column, target: Column) -> Column:
    """A box of a page of size ``page`` scaled into the box ``target`` and clipped to it."""
    sx, sy = width(target) / page["width"], height(target) / page["height"]
    clip = lambda v, low, high: F.least(F.greatest(v, low), high)
    return box(
        clip(target["x0"] + b["x0"] * sx, target["x0"], target["x1"]),
        clip(target["y0"] + b["y0"] * sy, target["y0"], target["y1"]),
        clip(target["x0"] + b["x1"] * sx, target["x0"], target["x1"]),
        clip(target["y0"] + b["y1"] * sy, target["y0"], target["y1"]),
    )


def _by_angle(angle: Column, b: Column, corners: dict[int, Sequence[Column]]) -> Column:
    out = F.when(angle == 0, b)
    for a, (x0, y0, x1, y1) in corners.items():
        out = out.when(angle == a, box(x0, y0, x1, y1))
    return out


def visual_to_unrotated(b: Column, page: Column, angle: Column) -> Column:
    """A box of the displayed page in the coordinates before rotation; ``page`` is the size before rotation."""
    w, h = page["width"], page["height"]
    return _by_angle(angle, b, {
        90: (b["y0"], h - b["x1"], b["y1"], h - b["x0"]),
        180: (w - b["x1"], h - b["y1"], w - b["x0"], h - b["y0"]),
        270: (w - b["y1"], b["x0"], w - b["y0"], b["x1"]),
    })


def unrotated_to_visual(b: Column, page: Column, angle: Column) -> Column:
    w, h = page["width"], page["height"]
    return _by_angle(angle, b, {
        90: (h - b["y1"], b["x0"], h - b["y0"], b["x1"]),
        180: (w - b["x1"], h - b["y1"], w - b["x0"], h - b["y0"]),
        270: (b["y0"], w - b["x1"], b["y1"], w - b["x0"]),
    })


def visual_page(page: Column, angle: Column) -> Column:
    """Size of the displayed page."""
    turned = angle.isin(90, 270)
    return F.struct(
        F.when(turned, page["height"]).otherwise(page["width"]).alias("width"),
        F.when(turned, page["width"]).otherwise(page["height"]).alias("height"),
    )


def is_horizontal(dx: Column, dy: Column, angle: Column) -> Column:
    """Whether a line of direction ``(dx, dy)`` before rotation runs left to right as displayed."""
    x = F.when(angle == 0, dx).when(angle == 90, -dy).when(angle == 180, -dx).otherwise(dy)
    y = F.when(angle == 0, dy).when(angle == 90, dx).when(angle == 180, -dy).otherwise(-dx)
    return (x > 0) & (F.abs(y) <= 0.1 * F.abs(x))


def inner_size(b: Column, padding: Column, angle: Column) -> Column:
    """Width and height for text in a box: without padding, swapped for text on its side."""
    w, h = F.greatest(width(b) - 2 * padding, F.lit(0.0)), F.greatest(height(b) - 2 * padding, F.lit(0.0))
    turned = F.pmod(angle, F.lit(180)) == 90
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def number_box(page: Column, body_bottom: Column, font: float = 8.0, gap: float = 4.0) -> Column:
    """Where a page number goes: a line below the body, across the page, within it."""
    top = F.least(body_bottom + gap, page["height"] - 2 * font)
    return box(F.lit(0.0), top, page["width"], top + 2 * font)


def image_dpi(page_width: Column, page_height: Column, pixels_x: Column, pixels_y: Column) -> Column:
    return F.greatest(pixels_x * 72.0 / page_width, pixels_y * 72.0 / page_height)
