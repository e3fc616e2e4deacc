"""Tables: from markup or positioned text to a grid, its measures and its pages.

What depends on the cells before it (span occupancy, greedy pagination, line
clustering) is folded table by table in Python, one row per table; everything
before and after is set-based.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Iterable
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from sparkfolio.functions import text as X
from sparkfolio.operators.folds import folded
from sparkfolio.operators.layout import NARROW, WIDE
from sparkfolio.thresholds import T

CELL = ST.StructType([
    ST.StructField("row", ST.IntegerType()), ST.StructField("column", ST.IntegerType()), ST.StructField("row_span", ST.IntegerType()),
    ST.StructField("column_span", ST.IntegerType()), ST.StructField("text", ST.StringType()), ST.StructField("header", ST.BooleanType()),
])


def clean(text: str) -> str:
    lines = (" ".join(x.split()) for x in text.splitlines())
    return "\n".join(x for x in lines if x)


def _span(value: str | None) -> int:
    try:
        return min(T.span_most, max(1, int(value or 1)))
    except ValueError:
        return 1


class _Rows(HTMLParser):
    """Rows of raw cells ``[text, row_span, column_span, header]``; unclosed tags end where the next one begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self._end()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._end()
            if not self.rows:
                self.rows.append([])
            named = dict(attrs)
            self.cell = ["", _span(named.get("rowspan")), _span(named.get("colspan")), tag == "th"]
        elif tag == "br" and self.cell is not None:
            self.cell[0] += "\n"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._end()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0] += data

    def _end(self) -> None:
        if self.cell is not None:
            self.cell[0] = clean(self.cell[0])
            self.rows[-1].append(self.cell)
            self.cell = None


def html_rows(content: str) -> list[list[list]]:
    parser = _Rows()
    parser.feed(content)
    parser.close()
    parser._end()
    return [r for r in parser.rows if r]


def markdown_rows(content: str) -> list[list[list]]:
    """Rows of a pipe table; an escaped pipe belongs to its cell, the rule below the header is no row."""
    out: list[list[list]] = []
    for line in content.splitlines():
        line = line.strip()
        if "|" not in line:
            continue
        cells, cell, held = [], "", False
        for c in line.strip("|") if not line.endswith("\\|") else line.lstrip("|"):
            if c == "|" and not held:
                cells.append(cell)
                cell = ""
                continue
            if held and c != "|":
                cell += "\\"
            held = c == "\\" and not held
            cell += "" if held else c
        cells.append(cell + "\\" * held)
        cells = [clean(c) for c in cells]
        if all(c and not c.strip("-: ") for c in cells):
            continue
        out.append([[c, 1, 1, not out] for c in cells])
    return out


def structured_rows(content: str | None) -> list[list[list]]:
    """Rows of an HTML or pipe table without leading rows that are one empty merged cell."""
    content = content or ""
    rows = html_rows(content) if "<table" in content.lower() else markdown_rows(content)
    while rows and len(rows[0]) == 1 and not rows[0][0][0]:
        rows = rows[1:]
    return rows


def width_hint(rows: list[list[list]]) -> int:
    """The most frequent width of rows, of equally frequent ones the larger."""
    widths = [sum(c[2] for c in r) for r in rows]
    return max(set(widths), key=lambda w: (widths.count(w), w), default=0)


def grid(rows: list[list[list]]) -> list[tuple[int, int, int, int, str, bool]]:
    """Cells in a span grid as ``(row, column, row_span, column_span, text, header)``.

    A cell takes the first free column of its row; spans are cut at other
    cells' places and at the last row, and at the width that most rows have,
    unless text stands beyond it.
    """
    width = width_hint(rows)
    wide = max((sum(c[2] for c in r) for r in rows if any(c[0] for c in r[width:])), default=0)
    width = max(width, wide)
    taken: set[tuple[int, int]] = set()
    out = []
    for i, row in enumerate(rows):
        j = 0
        for text, down, across, header in row:
            while (i, j) in taken:
                j += 1
            if j >= width:
                break
            across = min(across, width - j)
            while across > 1 and any((i, j + k) in taken for k in range(across)):
                across -= 1
            down = min(down, len(rows) - i)
            taken.update((i + a, j + b) for a in range(down) for b in range(across))
            out.append((i, j, down, across, text, header))
            j += across
    return out


def infer_headers(cells: list[tuple]) -> list[tuple]:
    """A second and third row are headers too as long as the one above is and less than half of them are data."""
    rows: dict[int, list] = {}
    for c in cells:
        rows.setdefault(c[0], []).append(c)
    data = lambda t: bool(t) and any(ch.isdigit() for ch in t)
    header = {i: any(c[5] for c in row) for i, row in rows.items()}
    for i in (1, 2):
        spanned = any(c[3] > 1 for c in rows.get(i - 1, []))
        if header.get(i - 1) and spanned and i in rows and sum(data(c[4]) for c in rows[i]) < 0.5 * len(rows[i]):
            header[i] = True
    return [(*c[:5], header[c[0]]) for c in cells]


_CELLS = pa.list_(pa.struct([("row", pa.int32()), ("column", pa.int32()), ("row_span", pa.int32()), ("column_span", pa.int32()), ("text", pa.string()), ("header", pa.bool_())]))


@F.arrow_udf(ST.ArrayType(CELL))
def cells_udf(contents: pa.Array) -> pa.Array:
    names = CELL.fieldNames()
    return pa.array([[dict(zip(names, c)) for c in infer_headers(grid(structured_rows(x)))] for x in contents.to_pylist()], _CELLS)


def extracted(tables: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """One row per cell of each table; a table without a grid has one row with null cells and ``unreconstructable``."""
    found = tables.select(*key, cells_udf(F.col(content)).alias("cells"), X.should_keep_as_image(F.col(content)).alias("preserve_as_image"))
    flat = found.select(*key, "preserve_as_image", (F.size("cells") == 0).alias("unreconstructable"), F.explode_outer("cells").alias("c"))
    return flat.select(*key, "preserve_as_image", "unreconstructable", "c.*")


def consensus_columns(rows: DataFrame, key: list[str], width: Column) -> DataFrame:
    """The most frequent width per table, of equally frequent ones the larger."""
    n = rows.groupBy(*key, width.alias("width")).agg(F.count("*").alias("rows"))
    return n.groupBy(*key).agg(F.max_by("width", F.struct("rows", "width")).alias("columns"))


def column_anchors(values: DataFrame, key: list[str], x: Column, columns: int, page_width: float) -> DataFrame:
    """Median place of each column over complete rows: two rows at least, columns apart, places close to the median."""
    rank = Window.partitionBy(*key, "row").orderBy(x)
    ranked = values.select(*key, "row", x.alias("x"), F.row_number().over(rank).alias("column"), F.count("*").over(Window.partitionBy(*key, "row")).alias("n"))
    median = ranked.where(F.col("n") == columns).groupBy(*key, "column").agg(F.median("x").alias("anchor"), F.count("*").alias("rows"), F.collect_list("x").alias("xs"))
    w = Window.partitionBy(*key).orderBy("column")
    gaps = median.select("*", (F.col("anchor") - F.lag("anchor").over(w)).alias("gap"))
    off = F.array_max(F.transform("xs", lambda v: F.abs(v - F.col("anchor"))))
    whole = Window.partitionBy(*key)
    checked = gaps.select(*key, "column", "anchor", "rows", F.min("gap").over(whole).alias("least"), F.max(off).over(whole).alias("off"))
    ok = (F.col("rows") >= 2) & (F.col("least") >= max(8.0, page_width / (5 * columns))) & (F.col("off") <= 0.38 * F.col("least"))
    return checked.where(ok).select(*key, "column", "anchor")


def nearest_anchor(values: DataFrame, anchors: DataFrame, key: list[str], x: Column) -> DataFrame:
    """Each value's column: the anchor closest to it, of equally close ones the first; null in a table without anchors."""
    listed = anchors.groupBy(*key).agg(F.collect_list(F.struct("column", "anchor")).alias("__anchors"))
    both = values.withColumn("__x", x).join(listed, key, "left")
    far = F.transform("__anchors", lambda a: F.struct(F.abs(F.col("__x") - a["anchor"]).alias("far"), a["column"].alias("column")))
    return both.withColumn("column", F.array_min(far)["column"]).drop("__x", "__anchors")


def matched_rows(left: DataFrame, right: DataFrame, key: list[str], label: str) -> DataFrame:
    """Pairs of rows with the same first cell, for tables where at least two match, each once and in order."""
    named = lambda df, side: df.select(*key, F.col("row").alias(side), X.key(F.col(label)).alias("__k"))
    once = lambda df, side: df.select("*", F.count("*").over(Window.partitionBy(*key, "__k")).alias(f"{side}_n"))
    pairs = once(named(left, "left_row"), "left").join(once(named(right, "right_row"), "right"), [*key, "__k"]).where("__k <> ''")
    w = Window.partitionBy(*key).orderBy("left_row")
    falls = F.coalesce(F.col("right_row") <= F.lag("right_row").over(w), F.lit(False))
    flagged = pairs.select("*", falls.alias("falls"))
    whole = Window.partitionBy(*key)
    good = flagged.select(
        "*", F.bool_or(F.col("falls") | (F.col("left_n") > 1) | (F.col("right_n") > 1)).over(whole).alias("bad"), F.count("*").over(whole).alias("n")
    )
    return good.where("not bad and n >= 2").select(*key, "left_row", "right_row")


def column_demand(cells: DataFrame, key: list[str], width: Column) -> DataFrame:
    """Width that each column asks for: its longest token, or the root of its text, capped; prose asks for more."""
    words = F.array_max(F.transform(F.split("text", r"\s+"), lambda w: F.length(w)))
    per = cells.select(*key, "column", (words * width).alias("token"), (F.length("text") * width).alias("total"), F.length("text").alias("chars"))
    grouped = per.groupBy(*key, "column").agg(F.max("token").alias("token"), F.max("total").alias("total"), F.max("chars").alias("chars"), F.count("*").alias("cells"))
    prose = F.least(F.lit(3.0), F.greatest(F.lit(1.0), F.col("chars") / 80))
    wanted = F.greatest(F.col("token") + 2 * T.cell_padding_x, F.sqrt(F.col("total") * 72) * prose, F.lit(T.column_least))
    return grouped.select(*key, "column", F.least(F.lit(T.column_cap), wanted).alias("demand"))


def allocated_widths(demand: DataFrame, key: list[str], total: Column | float) -> DataFrame:
    """``total`` dealt to columns by demand, to hundredths, what is left over to the last."""
    whole = Window.partitionBy(*key)
    room = F.lit(total) if isinstance(total, (int, float)) else total
    shares = demand.select(*key, "column", F.floor(F.col("demand") / F.sum("demand").over(whole) * room * 100).cast("long").alias("cents"), room.alias("__room"), F.max("column").over(whole).alias("last"))
    others = F.sum(F.when(F.col("column") < F.col("last"), F.col("cents"))).over(whole)
    rest = F.round(F.col("__room") * 100).cast("long") - F.coalesce(others, F.lit(0))
    return shares.select(*key, "column", (F.when(F.col("column") == F.col("last"), rest).otherwise(F.col("cents")) / 100).alias("width"))


def heights_of(cells: list[dict], line: float) -> dict[int, float]:
    """Height of each row of one table's cells ``row, row_span, need``, in the order of their rows."""
    heights: dict[int, float] = {}
    for c in cells:
        if c["row_span"] == 1:
            heights[c["row"]] = max(heights.get(c["row"], 0.0), c["need"])
    for c in cells:
        if c["row_span"] > 1:
            spanned = range(c["row"], c["row"] + c["row_span"])
            lacking = c["need"] - sum(heights.get(i, line) for i in spanned)
            heights[spanned[-1]] = heights.get(spanned[-1], line) + max(0.0, lacking)
    return heights


def row_heights(cells: DataFrame, key: list[str], line: float = T.body_font * T.line_height) -> DataFrame:
    """Height of each row: the largest of its cells of one row; cells that span rows add to the last row they span."""
    need = (F.col("lines") * line + 2 * T.cell_padding_y).alias("need")
    fold = lambda group: [{"row": r, "height": h} for r, h in sorted(heights_of(group, line).items())]
    flat = cells.select(*key, "row", "column", "row_span", need)
    return folded(flat, key, ["row", "column", "row_span", "need"], fold, "row int, height double")


def running_offsets(sizes: DataFrame, key: list[str], order: str, size: str, name: str) -> DataFrame:
    """Where each row or column begins: the sum of the sizes before it."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("*", F.coalesce(F.sum(size).over(w), F.lit(0.0)).alias(name))


def atomic_groups(cells: DataFrame, key: list[str]) -> DataFrame:
    """Rows that spans hold together: ``first, last`` of each group."""
    spans = cells.groupBy(*key, "row").agg(F.max(F.col("row") + F.col("row_span")).alias("end"))
    w = Window.partitionBy(*key).orderBy("row")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("row") >= reach, F.lit(True)).cast("int")
    marked = spans.select("*", new.alias("new")).select("*", F.sum("new").over(w).alias("g"))
    return marked.groupBy(*key, "g").agg(F.min("row").alias("first"), F.max("row").alias("last")).drop("g")


def pages(sizes: Iterable[float], first: float, more: float) -> list[int]:
    """The page of each group of rows, filled greedily; a group that fits on no page has one of its own."""
    out, page, left = [], 0, first
    for i, size in enumerate(sizes):
        if size > left and (i and out[-1] == page):
            page, left = page + 1, more
        elif size > left and i == 0 and size <= more:
            page, left = 1, more
        out.append(page)
        left -= size
    return out


def paginated(groups: DataFrame, key: list[str], first: Column, more: Column) -> DataFrame:
    """``groups(key, first, last, height)`` and the page of each, by a fold over a table's groups in their order.

    ``first`` and ``more`` are the room for rows on the first and each later
    page, the repeated header taken off.
    """
    deal = F.arrow_udf(lambda s, a, b: pa.array([pages(*row) for row in zip(s.to_pylist(), a.to_pylist(), b.to_pylist())], pa.list_(pa.int32())), ST.ArrayType(ST.IntegerType()))
    listed = groups.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", "last", "height"))).alias("g"), F.first(first).alias("a"), F.first(more).alias("b"))
    dealt = listed.select(*key, "g", deal(F.col("g.height"), "a", "b").alias("p"))
    flat = dealt.select(*key, F.explode(F.arrays_zip("g", "p")).alias("z"))
    return flat.select(*key, "z.g.*", F.col("z.p").alias("page"))


def redrawn_places(starts: np.ndarray, c: dict[str, np.ndarray], width: float, first: float, more: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Cells of whole tables set anew: the place of each cell drawn, and its ``part, x0, x1, y0, y1``.

    ``c`` has the cells' ``row, column, row_span, column_span, header, token,
    chars, wide`` in the order of their rows, ``starts`` where each table
    begins.  All but heights of rows that a span holds and the dealing to
    pages is done for all tables at once.
    """
    line, n, tables = T.body_font * T.line_height, len(c["row"]), len(starts)
    table = np.repeat(np.arange(tables), np.diff(np.append(starts, n)))

    def covered(begin: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Rows or columns that cells cover as ``table * stride + number``, the first of each cell, that of each place a cell covers."""
        stride = int((begin + span).max(initial=0)) + 1
        before = np.cumsum(span) - span
        found, at = np.unique(np.repeat(table * stride + begin - before, span) + np.arange(span.sum()), return_inverse=True)
        return found, at[before], at, stride

    # Columns: what they ask for and what they get, as in column_demand and allocated_widths.
    across, down = np.maximum(c["column_span"], 1), np.maximum(c["row_span"], 1)
    places, col, _, stride = covered(c["column"] - c["column"].min(initial=0), across)
    one, size, token, chars = across == 1, T.body_font * NARROW, np.zeros(len(places)), np.zeros(len(places))
    np.maximum.at(token, col[one], c["token"][one])
    np.maximum.at(chars, col[one], c["chars"][one])
    prose = np.minimum(3.0, np.maximum(1.0, chars / 80))
    wanted = np.maximum(np.maximum(token * size + 2 * T.cell_padding_x, np.sqrt(chars * size * 72) * prose), T.column_least)
    demand, owner = np.minimum(T.column_cap, wanted), places // stride
    cents = np.floor(demand / np.bincount(owner, demand)[owner] * width * 100)
    last = np.append(owner[1:] != owner[:-1], True)
    cents[last] = 0
    cents[last] = math.floor(width * 100 + 0.5) - np.bincount(owner, cents)
    right = np.cumsum(cents)
    left = right - cents
    base = left[np.append(True, last[:-1])][owner]
    x0, x1 = (left - base)[col] / 100, (right - base)[col + across - 1] / 100
    room = np.maximum(right[col + across - 1] - left[col] - 200 * T.cell_padding_x, 100 * T.body_font)  # in hundredths, in which a text that just fits does fit
    text_width = (c["wide"] * WIDE + (c["chars"] - c["wide"]) * NARROW) * T.body_font
    need = np.maximum(1, np.ceil(100 * text_width / room)) * line + 2 * T.cell_padding_y

    # Rows: heights as in heights_of, groups that spans hold together.
    lowest = c["row"].min(initial=0)
    spots, top, at, stride = covered(c["row"] - lowest, down)
    of, single = spots // stride, down == 1
    sizes = np.full(len(spots), -1.0)
    np.maximum.at(sizes, top[single], need[single])
    sizes[sizes < 0] = line
    for i in np.flatnonzero(~single):
        a, b = top[i], top[i] + down[i]
        sizes[b - 1] += max(0.0, need[i] - sum(sizes[a:b].tolist()))
    ends = np.zeros(len(spots), np.int64)
    np.maximum.at(ends, at, np.repeat(top + down - 1, down))
    begins = np.append(True, (np.arange(1, len(spots)) > np.maximum.accumulate(ends)[:-1]) | (of[1:] != of[:-1]))
    group = np.cumsum(begins) - 1
    opens = np.flatnonzero(begins)
    closes = np.append(opens[1:], len(spots))
    tall = sizes[opens]
    for g in np.flatnonzero(closes - opens > 1):
        tall[g] = sum(sizes[opens[g] : closes[g]].tolist())

    # Pages: the header rows of each table, its other groups dealt.
    head = np.full(tables, -1)
    np.maximum.at(head, table[c["header"]], c["row"][c["header"]])
    heading = spots[closes - 1] % stride + lowest <= head[of[opens]]
    headed, groups = np.bincount(of[opens], heading, tables).astype(int), np.bincount(of[opens], minlength=tables)
    row_first = np.searchsorted(of, np.arange(tables))
    head_rows = np.bincount(of, heading[group], tables).astype(int)
    page, talls, at_group = np.full(len(opens), -1), tall.tolist(), 0
    for t, (k, m) in enumerate(zip(headed.tolist(), groups.tolist())):
        taken = sum(sizes[row_first[t] : row_first[t] + head_rows[t]].tolist()) if k else 0
        page[at_group + k : at_group + m] = pages(talls[at_group + k : at_group + m], first - taken, more - taken)
        at_group += m
    body = np.flatnonzero(~heading[group])
    row_page = page[group]
    new = np.append(True, (of[body][1:] != of[body][:-1]) | (row_page[body][1:] != row_page[body][:-1]))[: len(body)]
    bare = np.flatnonzero(headed == groups)  # a header alone is drawn once
    part_table = np.concatenate([of[body[new]], bare])
    part_no = np.concatenate([row_page[body[new]], np.zeros(len(bare), int)])
    part_first = np.concatenate([body[new], np.zeros(len(bare), int)])
    part_rows = np.concatenate([np.diff(np.append(np.flatnonzero(new), len(body))), np.zeros(len(bare), int)])

    # Rows as drawn, part by part: the header's, then the part's own; and their cells.
    heads = head_rows[part_table]
    length = heads + part_rows
    begin = np.cumsum(length) - length
    part = np.repeat(np.arange(len(length)), length)
    nth = np.arange(len(part)) - begin[part]
    drawn = np.where(nth < heads[part], row_first[part_table][part] + nth, part_first[part] + nth - heads[part])
    tall_rows, bottoms = sizes[drawn].tolist(), []
    for a, k in zip(begin.tolist(), length.tolist()):
        bottoms.extend(accumulate(tall_rows[a : a + k]))
    y1 = np.array(bottoms, float)
    y0 = np.append(0.0, y1[:-1])[: len(y1)]
    y0[nth == 0] = 0.0
    held = np.bincount(top, minlength=len(spots))
    cell_first = np.cumsum(held) - held
    times = held[drawn]
    row_at = np.repeat(np.arange(len(drawn)), times)
    cell = cell_first[drawn][row_at] + np.arange(len(row_at)) - (np.cumsum(times) - times)[row_at]
    return cell, {"part": part_no[part[row_at]], "x0": x0[cell], "y0": y0[row_at], "x1": x1[cell], "y1": y1[row_at + down[cell] - 1]}


def coverage_faults(parts: DataFrame, key: list[str], rows: DataFrame) -> DataFrame:
    """Rows that the parts ``(first, last)`` do not cover exactly once."""
    covered = parts.select(*key, F.explode(F.sequence("first", "last")).alias("row")).groupBy(*key, "row").agg(F.count("*").alias("times"))
    return rows.join(covered, [*key, "row"], "full").where("coalesce(times, 0) <> 1").select(*key, "row", F.coalesce("times", F.lit(0)).alias("times"))


def header_text(cells: DataFrame, key: list[str]) -> DataFrame:
    """The text of a table's header cells in reading order, a line each."""
    ordered = F.array_sort(F.collect_list(F.struct("row", "column", "text")))
    return cells.where("header").groupBy(*key).agg(F.array_join(F.transform(ordered, lambda c: c["text"]), "\n").alias("header_text"))


def line_clusters(boxes: list[tuple[float, float]]) -> list[int]:
    """Visual lines of boxes ``(y centre, height)`` by centre: close to the running median of the line so far."""
    if not boxes:
        return []
    tallest = max(h for _, h in boxes)
    tolerance = min(max(T.line_tolerance * tallest, T.line_tolerance_least), T.line_tolerance_most)
    out, line, held = [0] * len(boxes), -1, []
    for i in sorted(range(len(boxes)), key=lambda i: boxes[i][0]):
        y = boxes[i][0]
        if not held or abs(y - statistics.median(held)) > tolerance:
            line, held = line + 1, []
        held.append(y)
        out[i] = line
    return out


@F.arrow_udf(ST.ArrayType(ST.IntegerType()))
def line_clusters_udf(centres: pa.Array, heights: pa.Array) -> pa.Array:
    return pa.array([None if c is None else line_clusters(list(zip(c, h))) for c, h in zip(centres.to_pylist(), heights.to_pylist())], pa.list_(pa.int32()))
