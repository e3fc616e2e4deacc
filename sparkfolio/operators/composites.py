"""Operators made of others: payload enrichment, table repair, unit extraction, the translation ledger."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.adapters import Translator, translated
from sparkfolio.functions import geometry as G
from sparkfolio.functions import text as X
from sparkfolio.operators import regions as R
from sparkfolio.operators import semantics as S
from sparkfolio.operators import tables as B
from sparkfolio.operators import terms as M
from sparkfolio.operators import units as U
from sparkfolio.operators.folds import batch_folded, folded
from sparkfolio.thresholds import T

PAGE = ["doc_id", "page_idx"]


def page_sizes(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Size and angle per page: the page's own, else that of its first element."""
    e = elements.groupBy(*PAGE).agg(F.min_by(F.struct("page_width", "page_height"), "idx").alias("e"))
    both = pages.join(e, PAGE, "full")
    own = G.pair(F.col("width"), F.col("height"))
    size = F.coalesce(own, G.pair(F.col("e.page_width"), F.col("e.page_height")))
    return both.select(*PAGE, size["width"].alias("width"), size["height"].alias("height"), F.coalesce("angle", F.lit(0)).alias("angle"))


def merged_layouts(parts: DataFrame) -> DataFrame:
    """Page layouts of one document as one: counters add up, the first metadata stays, retried pages and the largest resolution are told."""
    return parts.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum("blocks").alias("blocks"), F.sum("corrections").alias("corrections"), F.min_by("metadata", "page_idx").alias("metadata"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("angle") != 0, F.col("page_idx")))).cast("array<string>"), ",").alias("retried"), F.max("dpi").alias("dpi"),
    )


def enriched(regions: DataFrame, contents: DataFrame) -> DataFrame:
    """Regions with the parsed content of their type that overlaps them most; content without a region becomes one.

    ``contents(doc_id, page_idx, idx, type, bbox, content)``.  Where several
    contents of a type are on a page without such a region, the first makes a
    region, and each further one joins it or makes its own if a region is
    already taken.
    """
    r = regions.select(*PAGE, "region_idx", S.canonical(F.col("type")).alias("type"), F.col("bbox").alias("r_bbox"))
    c = contents.withColumn("type", S.canonical(F.col("type")))
    pairs = c.join(r, [*PAGE, "type"]).select(*PAGE, "type", "idx", "content", "region_idx", G.shared(F.col("bbox"), F.col("r_bbox")).alias("shared"))
    best = Window.partitionBy(*PAGE, "idx").orderBy(F.desc("shared"), "region_idx")
    owner = Window.partitionBy(*PAGE, "region_idx").orderBy(F.desc("shared"), "idx")
    chosen = pairs.select("*", F.row_number().over(best).alias("b")).where("b = 1").select("*", F.row_number().over(owner).alias("o"))
    attached = chosen.where("o = 1").select(*PAGE, "region_idx", "content")
    kept = r.join(attached, [*PAGE, "region_idx"], "left").select(*PAGE, "region_idx", "type", F.col("r_bbox").alias("bbox"), "content")
    left = c.join(chosen.where("o = 1").select(*PAGE, "idx"), [*PAGE, "idx"], "left_anti")
    next_idx = F.row_number().over(Window.partitionBy(*PAGE).orderBy("idx"))
    top = r.groupBy(*PAGE).agg((F.max("region_idx") + 1).alias("top"))
    made = left.join(top, PAGE, "left").select(*PAGE, (F.coalesce("top", F.lit(0)) + next_idx - 1).cast("int").alias("region_idx"), "type", "bbox", "content")
    return kept.unionByName(made)


def contained_texts(tables: DataFrame, blocks: DataFrame, slack: float = 1.0) -> DataFrame:
    """Texts whose centre lies in a table's box, once each, numbered by their place."""
    b = blocks.select(*PAGE, "n", "text", F.col("bbox").alias("b_bbox"))
    inside = tables.join(b, PAGE).where(G.center_in(F.col("b_bbox"), F.col("bbox"), slack))
    x, y = F.round(G.center_x(F.col("b_bbox")), 2), F.round(G.center_y(F.col("b_bbox")), 2)
    once = inside.select(*PAGE, "region_idx", "text", y.alias("y"), x.alias("x")).dropDuplicates()
    w = Window.partitionBy(*PAGE, "region_idx").orderBy("y", "x", "text")
    return once.select("*", (F.row_number().over(w) - 1).alias("position"))


def heading_style(bbox: Column, text: Column, page_width: float, page_height: float, page_idx: Column) -> tuple[Column, Column]:
    """Whether a heading is its document's title, and how it is aligned: centred if it sits about the middle."""
    title = (page_idx == 0) & (bbox["y0"] <= 0.25 * page_height) & ~X.is_numbered_heading(text)
    off = F.abs(G.center_x(bbox) - page_width / 2)
    centred = (off <= 0.03 * page_width) & (G.width(bbox) <= 0.8 * page_width)
    return title, F.when(centred, "center").when(bbox["x0"] > page_width / 2, "right").otherwise("left")


def pixel_regions(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Boxes that stay pixels: visual regions, visual blocks of types that no region of the page has, each box once."""
    both = S.with_fallback(regions, blocks).where(S.is_visual(F.col("type")) | S.is_formula(F.col("type")))
    corner = [F.round(f"bbox.{c}", 1).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return both.select(*PAGE, "type", *corner).dropDuplicates([*PAGE, "x0", "y0", "x1", "y1"])


def unsafe_area(bbox: Column, text: Column, segment_width: float, size: float = T.body_font) -> Column:
    """Why a text is put off: too narrow for its column, too low, or more than fits."""
    from sparkfolio.operators.layout import line_count

    need = line_count(text, size, G.width(bbox)) * size * T.line_height
    return F.when(G.width(bbox) < 0.18 * segment_width, "narrow").when(G.height(bbox) < 8, "low").when(need > G.height(bbox), "overflow")


def header_columns(texts: DataFrame, cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """Column interval of each header cell: its texts, clustered by gaps, next to the anchors they are closest to.

    ``texts(table, x, text)``, ``cells(table, cell, text)``, ``anchors(table,
    column, anchor)``; cells are taken in order, each after the one before.
    """
    c = cells.select("table", "cell", X.key(F.col("text")).alias("cell_key"))
    t = texts.select("table", "x", X.key(F.col("text")).alias("k")).where("k <> ''")
    found = t.join(c, "table").where(F.contains("cell_key", F.col("k"))).select("table", "cell", "x", "k")
    clustered = R.gap_clusters(found, ["table", "cell"], "k", F.col("x"), T.cluster_gap * 4)
    spans = clustered.groupBy("table", "cell", "cluster").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    near = lambda x: F.min_by("column", F.struct(F.abs(F.col("anchor") - F.col(x)), F.col("column")))
    mapped = spans.join(anchors, "table").groupBy("table", "cell", "cluster").agg(near("a").alias("first"), near("b").alias("last"))

    def in_order(options: list[dict]) -> list[dict]:
        end, out = -1, []
        for o in options:
            if o["first"] is not None and o["first"] > end and not (out and out[-1]["cell"] == o["cell"]):
                out.append({k: o[k] for k in ("cell", "first", "last")})
                end = o["last"]
        return out

    kind = dict(mapped.dtypes)
    result = ", ".join(f"{k} {kind[k]}" for k in ("cell", "first", "last"))
    return folded(mapped, ["table"], ["cell", "first", "last"], in_order, result)


def disjoint_cover(intervals: DataFrame, columns: DataFrame) -> DataFrame:
    """Whether a table's intervals ``(table, first, last)`` cover each of its ``columns`` columns exactly once."""
    n = intervals.select("table", F.explode(F.sequence("first", "last")).alias("c")).groupBy("table").agg(F.count("*").alias("n"), F.count_distinct("c").alias("d"))
    return columns.join(n, "table", "left").select("table", ((F.coalesce("n", F.lit(0)) == F.col("columns")) & (F.coalesce("d", F.lit(0)) == F.col("columns"))).alias("covered"))


def recovered_trailing(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """Texts under a table's last filled row, each in the empty cell that holds it, else in the nearest one.

    ``texts(table, n, text, bbox)``, ``cells(table, row, column, bbox)``: the
    cells of the last, blank row.
    """
    c = cells.select("table", "row", "column", F.col("bbox").alias("c_bbox"))
    a, b = F.col("bbox"), F.col("c_bbox")
    far = F.pow(G.center_x(a) - G.center_x(b), 2) + F.pow(G.center_y(a) - G.center_y(b), 2)
    rank = F.struct((~G.center_in(a, b)).cast("int"), far, F.col("row"), F.col("column"))
    placed = texts.join(c, "table").groupBy("table", "n", "text").agg(F.min_by(F.struct("row", "column"), rank).alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda t: t["text"])
    return placed.groupBy("table", "at.row", "at.column").agg(F.array_join(ordered, "\n").alias("text"))


def heading_units(blocks: DataFrame, regions: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Headings: outside furniture, by their region or on their own, merged side by side, not on pixel pages."""
    clear = R.outside_bands(blocks, R.furniture_bands(blocks, page_height))
    kind = S.effective(S.canonical(F.col("type")), F.col("text"))
    headings = clear.where(kind.isin(*S.HEADINGS))
    merged = R.merged_headings(headings, page_width)
    return merged.join(S.preserved_pages(blocks), PAGE, "left_anti")


def body_units(blocks: DataFrame, regions: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Body texts by region: admitted regions' members in reading order; what no region covers is a unit of its own."""
    clear = R.outside_bands(blocks, R.furniture_bands(blocks, page_height))
    body = regions.where(S.canonical(F.col("type")) == "text")
    held = R.members(R.without_wrappers(body), clear)
    first = held.groupBy(*PAGE, "n").agg(F.min("region_idx").alias("region_idx"))
    named = clear.where(S.is_source_text(S.canonical(F.col("type")))).join(first, [*PAGE, "n"], "left")
    unit = F.coalesce(F.col("region_idx"), -1 - F.col("n")).alias("unit")
    rows = named.select(*PAGE, unit, "text", F.col("bbox.y0").alias("y"), F.col("bbox.x0").alias("x"))
    return U.assembled(rows, [*PAGE, "unit"]).join(S.preserved_pages(blocks), PAGE, "left_anti")


def translation_ledger(units: DataFrame, translator: Translator, target: str, terms: DataFrame | None = None) -> DataFrame:
    """The ledger of units ``(doc_id, unit_id, kind, page_idx, y, x, text)``: order, context, facts, translation, terms.

    Context is source text, so units do not wait for one another.  Units that
    need no translation stay; a term that is a whole unit decides its text.
    """
    placed = U.with_context(U.reading_order(units))
    wanted = placed.where(X.needs_translation(F.col("text"), target) & ~X.is_locked(F.col("text")))
    said = translated(U.masked(wanted), translator, target)
    out = placed.join(said, "unit_id", "left")
    final = X.collapse_acronyms(F.col("target")) if target.lower().startswith("en") else F.col("target")
    if terms is not None:
        exact = M.exact_targets(placed.select("unit_id", "text", F.lit(target).alias("language")), terms)
        out = out.join(exact.select("unit_id", "required_target"), "unit_id", "left")
        final = F.coalesce("required_target", final)
    return out.select(
        "doc_id", "unit_id", "kind", "page_idx", "position", F.col("text").alias("source"), F.coalesce(final, F.col("text")).alias("target"),
        F.col("attempts").isNotNull().alias("translated"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "error",
    )


def table_units(regions: DataFrame) -> DataFrame:
    """Cells of table regions ``(doc_id, page_idx, region_idx, content)`` with offsets in their grid."""
    return B.extracted(regions, ["doc_id", "page_idx", "region_idx"])


def job_status(manifest: DataFrame, artifacts: dict[str, str]) -> DataFrame:
    """The last state of each job with a valid id, and where each named artifact of a finished one lies."""
    valid = manifest.where(F.col("job_id").rlike("^[0-9a-f]{32}$"))
    last = valid.groupBy("job_id").agg(F.max_by(F.struct("status", "stage", "progress", "folder"), F.struct("at", "progress")).alias("s"))
    done = F.col("s.status") == "done"
    named = [F.when(done, F.concat(F.col("s.folder"), F.lit(f"/{file}"))).alias(name) for name, file in artifacts.items()]
    return last.select("job_id", "s.status", "s.stage", "s.progress", *named)


def spec_template(elements: DataFrame) -> DataFrame:
    """An empty layout specification: each text element with defaults and no target text."""
    return elements.select(
        "doc_id", "page_idx", F.concat(F.lit("p"), (F.col("page_idx") + 1).cast("string"), F.lit("-e"), (F.col("n") + 1).cast("string")).alias("element_id"),
        F.lit("text").alias("type"), "bbox", F.col("text").alias("source_text"), F.lit("").alias("text"), F.round(G.height(F.col("bbox")) * 0.8, 2).alias("font_size"),
        F.lit(6.0).alias("min_font_size"), F.lit("left").alias("align"), F.lit("#000000").alias("color"),
    )


def source_layer(blocks: DataFrame, page_height: float) -> DataFrame:
    """``doc_id, page_idx, n, text, bbox, disposition`` of every block; the text layer is made of those that are ``source``.

    A block that no rule on types leaves out is furniture if it lies in a
    page's band of furniture.
    """
    pixels = S.preserved_pages(blocks).select(*PAGE, F.lit(True).alias("pixels"))
    clear = R.outside_bands(blocks, R.furniture_bands(blocks, page_height)).select(*PAGE, "n", F.lit(True).alias("clear"))
    known = blocks.join(pixels, PAGE, "left").join(clear, [*PAGE, "n"], "left")
    reason = S.disposition(S.canonical(F.col("type")), F.col("bbox"), F.coalesce("pixels", F.lit(False)))
    said = known.select(*PAGE, "n", "text", "bbox", "clear", reason.alias("reason"))
    placed = F.when((F.col("reason") == "source") & F.col("clear").isNull(), "furniture").otherwise(F.col("reason"))
    return said.select(*PAGE, "n", "text", "bbox", placed.alias("disposition"))


def redrawn_tables(cells: DataFrame, key: list[str], width: float, first: float, more: float) -> DataFrame:
    """Tables set anew: columns measured, texts broken, rows dealt to pages, the header repeated on each.

    ``cells(key, row, column, row_span, column_span, text, header)`` become
    ``key, part, row, column, header, text, x0, y0, x1, y1``.  ``part`` 0 has
    room for ``first`` points of the table, every later one for ``more``; rows
    that a span holds together stay on one page.  Header rows are those from
    the top down to the last that has a header cell and that no span ties to
    the rows below.  Cells without a place or span are left out.

    Cells are shuffled once, unless they lie by ``key`` already, and placed for
    many tables in one call; memory follows the largest table.
    """
    numbers = ["row", "column", "row_span", "column_span"]
    text = F.coalesce("text", F.lit(""))
    chars = F.length(text)
    longest = F.when(text.rlike(r"\s"), F.array_max(F.transform(F.split(text, r"\s+"), lambda w: F.length(w)))).otherwise(chars)
    columns = {**{c: c for c in (*numbers, "header", "text")}, "token": longest, "chars": chars, "wide": X.count(text, X.CJK_WIDE)}

    def placed(table: pa.RecordBatch, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        c = {name: table.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in (*numbers, "token", "chars", "wide")}
        c["header"] = pc.fill_null(table.column("header"), False).to_numpy(zero_copy_only=False)
        return B.redrawn_places(starts, c, width, first, more)

    result = "part int, row int, column int, header boolean, text string, x0 double, y0 double, x1 double, y1 double"
    return batch_folded(cells.dropna(subset=numbers), key, ["row", "column", "row_span", "header", "text"], columns, placed, result)
