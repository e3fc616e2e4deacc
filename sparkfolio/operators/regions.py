"""Joins between boxes of one page.

Every join has document and page as equality keys, so geometry is only ever a
residual condition within a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions import geometry as G
from sparkfolio.operators.folds import folded
from sparkfolio.operators.semantics import canonical, is_furniture_text
from sparkfolio.thresholds import T

PAGE = ["doc_id", "page_idx"]


def _named(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*PAGE, *[F.col(c).alias(f"{prefix}{c}") for c in columns])


def typed_blocks(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Each block with the type of the region that holds it best, ``text`` where none does.

    A region holds a block whose centre is in it or that it covers by half;
    the best has the centre, then covers most, is surest, smallest, first.
    """
    r = _named(regions, "r_", "region_idx", "type", "confidence", "bbox")
    b, rb = F.col("bbox"), F.col("r_bbox")
    held = G.center_in(b, rb) | (G.overlap_of(b, rb) >= T.typing_overlap)
    rank = F.struct(
        G.center_in(b, rb).cast("int"), G.overlap_of(b, rb), F.coalesce("r_confidence", F.lit(0.0)), -G.area(rb), -F.col("r_region_idx"),
    )
    best = (
        blocks.join(r, PAGE)
        .where(held)
        .groupBy(*PAGE, "n")
        .agg(F.max_by(F.struct(F.col("r_type").alias("type"), F.col("r_region_idx").alias("idx")), rank).alias("best"))
    )
    return blocks.drop("type").join(best, [*PAGE, "n"], "left").select(
        *PAGE, "n", "text", "bbox", F.coalesce("best.type", F.lit("text")).alias("type"), F.col("best.idx").alias("region_idx")
    )


def members(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """``region_idx, n`` for every region and block whose boxes share area."""
    b = _named(blocks, "b_", "n", "bbox")
    both = regions.join(b, PAGE).where(G.overlap_of_smaller(F.col("bbox"), F.col("b_bbox")) > 0)
    return both.select(*PAGE, "region_idx", F.col("b_n").alias("n"))


def best_region(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Each block's region with the largest share of the smaller box, of equal ones the last."""
    r = _named(regions, "r_", "region_idx", "bbox")
    score = G.overlap_of_smaller(F.col("bbox"), F.col("r_bbox"))
    rank = Window.partitionBy(*PAGE, "n").orderBy(F.desc("score"), F.desc("r_region_idx"))
    both = blocks.join(r, PAGE).select(*PAGE, "n", "r_region_idx", score.alias("score")).where("score > 0")
    best = both.select("*", F.row_number().over(rank).alias("at")).where("at = 1")
    return best.select(*PAGE, "n", F.col("r_region_idx").alias("region_idx"), F.round("score", 6).alias("score"))


def assigned(regions: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target block goes to one region, a region may own many.

    The score is the shared part of the smaller box plus that of the smaller
    height; taking pairs from the best down and using each target once comes
    to the best region of each target, of equal ones the last.
    """
    t = _named(targets, "t_", "n", "bbox")
    a, b = F.col("bbox"), F.col("t_bbox")
    score = F.round(G.overlap_of_smaller(a, b) + G.vertical_ratio(a, b), 9)
    both = regions.join(t, PAGE).where(G.shared(a, b) > 0).select(*PAGE, "t_n", "region_idx", score.alias("score"))
    rank = Window.partitionBy(*PAGE, "t_n").orderBy(F.desc("score"), F.desc("region_idx"))
    best = both.select("*", F.row_number().over(rank).alias("at")).where("at = 1")
    return best.select(*PAGE, F.col("t_n").alias("n"), "region_idx", "score")


def uncovered(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks that share no area with any region of their page."""
    r = _named(regions, "r_", "bbox").withColumnsRenamed({"doc_id": "r_doc", "page_idx": "r_page"})
    same = (F.col("doc_id") == F.col("r_doc")) & (F.col("page_idx") == F.col("r_page"))
    return blocks.join(r, same & (G.shared(F.col("bbox"), F.col("r_bbox")) > 0), "left_anti")


def furniture_bands(blocks: DataFrame, page_height: float) -> DataFrame:
    """``header_bottom, footer_top`` per page: the furniture's edge, moved over blocks close to it.

    A block in the top or bottom half belongs to the band if its near edge is
    within T.band_near of the page height of the furniture's and taking it in
    moves the edge by no more than T.band_extension plus its own height.
    """
    kind = canonical(F.col("type"))
    top = is_furniture_text(kind) & (G.center_y(F.col("bbox")) < page_height / 2)
    bottom = is_furniture_text(kind) & (G.center_y(F.col("bbox")) >= page_height / 2)
    anchors = blocks.groupBy(*PAGE).agg(
        F.max(F.when(top, F.col("bbox.y1"))).alias("head"), F.min(F.when(bottom, F.col("bbox.y0"))).alias("foot")
    )
    near, more = T.band_near * page_height, T.band_extension * page_height
    both = blocks.where(~is_furniture_text(kind)).join(anchors, PAGE)
    y0, y1 = F.col("bbox.y0"), F.col("bbox.y1")
    extended = both.groupBy(*PAGE).agg(
        F.max(F.when((y0 < F.col("head")) & (y1 <= F.col("head") + near), F.least(y1, F.col("head") + more))).alias("head_more"),
        F.min(F.when((y1 > F.col("foot")) & (y0 >= F.col("foot") - near), F.greatest(y0, F.col("foot") - more))).alias("foot_more"),
    )
    return anchors.join(extended, PAGE, "left").select(
        *PAGE, F.greatest("head", "head_more").alias("header_bottom"), F.least("foot", "foot_more").alias("footer_top")
    )


def outside_bands(blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """Blocks whose centre is in no band and that none covers by half; a page without furniture has no band."""
    b = F.col("bbox")
    share = lambda top, bottom: F.greatest(F.lit(0.0), F.least(b["y1"], bottom) - F.greatest(b["y0"], top)) / G.height(b)
    head, foot, low = F.col("header_bottom"), F.col("footer_top"), F.lit(1e9)
    inside = (
        (G.center_y(b) <= head) | (head.isNotNull() & (share(F.lit(0.0), head) >= 0.5)) | (G.center_y(b) >= foot) | (foot.isNotNull() & (share(foot, low) >= 0.5))
    )
    return blocks.join(bands, PAGE, "left").where(~F.coalesce(inside, F.lit(False))).drop("header_bottom", "footer_top")


def neighbours(blocks: DataFrame) -> DataFrame:
    """Edges of the nearest content above and below each block, among what shares its columns.

    ``above`` is the lowest bottom edge of blocks that end over its top,
    ``below`` the highest top edge of those that begin under its bottom.
    """
    o = _named(blocks, "o_", "n", "bbox")
    a, b = F.col("bbox"), F.col("o_bbox")
    beside = (F.col("n") != F.col("o_n")) & (G.horizontal_ratio(a, b) >= T.neighbour_overlap)
    found = blocks.join(o, PAGE).where(beside).groupBy(*PAGE, "n").agg(
        F.max(F.when(b["y1"] <= a["y0"], b["y1"])).alias("above"), F.min(F.when(b["y0"] >= a["y1"], b["y0"])).alias("below")
    )
    return blocks.select(*PAGE, "n").join(found, [*PAGE, "n"], "left")


def table_captions(blocks: DataFrame, regions: DataFrame, page_height: float) -> DataFrame:
    """Blocks right over a table: shared columns, bottom edge close to the table's top."""
    tables = regions.where(canonical(F.col("type")) == "table")
    r = _named(tables, "r_", "bbox").withColumnsRenamed({"doc_id": "r_doc", "page_idx": "r_page"})
    a, t = F.col("bbox"), F.col("r_bbox")
    same = (F.col("doc_id") == F.col("r_doc")) & (F.col("page_idx") == F.col("r_page"))
    gap = t["y0"] - a["y1"]
    close = (gap <= T.caption_above * page_height) & (gap >= -T.caption_below * page_height)
    over = G.overlap_x(a, t) / G.width(a) >= T.caption_overlap
    return blocks.join(r, same & close & over, "left_semi").select(*PAGE, "n")


def follows_heading(blocks: DataFrame, headings: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Blocks with a heading directly over them."""
    h = _named(headings, "h_", "bbox").withColumnsRenamed({"doc_id": "h_doc", "page_idx": "h_page"})
    a, b = F.col("bbox"), F.col("h_bbox")
    same = (F.col("doc_id") == F.col("h_doc")) & (F.col("page_idx") == F.col("h_page"))
    gap = a["y0"] - b["y1"]
    shift = F.greatest(F.lit(0.0), F.greatest(a["x0"], b["x0"]) - F.least(a["x1"], b["x1"]))
    close = (gap >= 0) & (gap <= T.heading_gap * page_height) & (shift <= T.heading_shift * page_width)
    return blocks.join(h, same & close, "left_semi").select(*PAGE, "n")


def admitted(blocks: DataFrame, regions: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Body candidates that are admitted: wide enough, below the top margin or after a heading, no caption, not over visuals."""
    headings = regions.where(canonical(F.col("type")) == "section_heading")
    visual = regions.where(canonical(F.col("type")).isin("image", "chart", "seal", "table"))
    after = follows_heading(blocks, headings, page_width, page_height).withColumn("after", F.lit(True))
    captions = table_captions(blocks, regions, page_height).withColumn("caption", F.lit(True))
    v = _named(visual, "v_", "bbox")
    covered = blocks.join(v, PAGE).groupBy(*PAGE, "n").agg(F.max(G.overlap_of(F.col("bbox"), F.col("v_bbox"))).alias("covered"))
    flagged = blocks.join(after, [*PAGE, "n"], "left").join(captions, [*PAGE, "n"], "left").join(covered, [*PAGE, "n"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    wide = G.width(F.col("bbox")) >= T.body_width * page_width
    low = F.col("bbox.y0") >= T.body_top * page_height
    clear = F.coalesce(F.col("covered"), F.lit(0.0)) < T.body_visual_overlap
    return flagged.where((wide | yes("after")) & (low | yes("after")) & clear & ~yes("caption")).select(*PAGE, "n")


def without_wrappers(regions: DataFrame) -> DataFrame:
    """Regions without those that only wrap others: two or more lie in them and fill most of their area."""
    c = _named(regions, "c_", "region_idx", "bbox")
    a, b = F.col("bbox"), F.col("c_bbox")
    child = (F.col("region_idx") != F.col("c_region_idx")) & (G.overlap_of(b, a) >= T.duplicate_overlap) & (G.area(b) < G.area(a))
    filled = (
        regions.join(c, PAGE).where(child).groupBy(*PAGE, "region_idx")
        .agg(F.count("*").alias("children"), F.sum(G.shared(a, b)).alias("filled"), F.first(G.area(a)).alias("own"))
    )
    wraps = filled.where((F.col("children") >= T.wrapper_children) & (F.col("filled") >= T.wrapper_cover * F.col("own")))
    return regions.join(wraps.select(*PAGE, "region_idx"), [*PAGE, "region_idx"], "left_anti")


def without_duplicates(regions: DataFrame) -> DataFrame:
    """Regions in their order without those that nearly coincide with one kept before (a page in one call)."""

    def first_wins(page: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for r in page:
            size = (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
            for k in kept:
                w, h = min(k["x1"], r["x1"]) - max(k["x0"], r["x0"]), min(k["y1"], r["y1"]) - max(k["y0"], r["y0"])
                if max(w, 0) * max(h, 0) >= T.duplicate_overlap * max((k["x1"] - k["x0"]) * (k["y1"] - k["y0"]), size):
                    break
            else:
                kept.append(r)
        return [{"region_idx": k["region_idx"]} for k in kept]

    flat = regions.select(*PAGE, "region_idx", "bbox.*")
    kept = folded(flat, PAGE, ["region_idx", "x0", "y0", "x1", "y1"], first_wins, "region_idx int")
    return regions.join(kept, [*PAGE, "region_idx"], "left_semi")


def merged_headings(headings: DataFrame, page_width: float) -> DataFrame:
    """Headings side by side as one: much shared height and a small gap, growing from left to right.

    ``doc_id, page_idx, members array<int>, bbox``; a page's headings are few
    and folded in their order.
    """

    def fold(page: list[dict]) -> list[dict]:
        groups: list[dict] = []
        for r in page:
            for g in reversed(groups):
                shared = min(g["y1"], r["y1"]) - max(g["y0"], r["y0"])
                gap = max(g["x0"], r["x0"]) - min(g["x1"], r["x1"])
                if shared >= T.merge_overlap * min(g["y1"] - g["y0"], r["y1"] - r["y0"]) and gap <= T.merge_gap * page_width:
                    g["members"].append(r["n"])
                    for side, better in (("x0", min), ("y0", min), ("x1", max), ("y1", max)):
                        g[side] = better(g[side], r[side])
                    break
            else:
                groups.append({"members": [r["n"]], **{side: r[side] for side in ("x0", "y0", "x1", "y1")}})
        return groups

    flat = headings.select(*PAGE, "n", "bbox.*")
    out = folded(flat, PAGE, ["y0", "x0", "n", "x1", "y1"], fold, "members array<int>, x0 double, y0 double, x1 double, y1 double")
    return out.select(*PAGE, "members", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"))


def islands(rows: DataFrame, group: list[str], order: str, start: Column, end: Column, slack: float = 0.0, touching: bool = True) -> DataFrame:
    """``rows`` and ``island``: overlapping intervals of a group have one number.

    An interval begins a new island if it starts beyond all before it by more
    than ``slack``; with ``touching`` false already where it starts at their end.
    """
    w = Window.partitionBy(*group).orderBy(start, end, order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (start > reach + slack) if touching else (start >= reach + slack)
    flagged = rows.select("*", F.coalesce(new, F.lit(True)).cast("int").alias("__new"))
    return flagged.select("*", (F.sum("__new").over(w) - 1).cast("int").alias("island")).drop("__new")


def gap_clusters(rows: DataFrame, group: list[str], order: str, centre: Column, gap: float) -> DataFrame:
    """``rows`` and ``cluster``: a new one begins where the centre is more than ``gap`` from the one before."""
    w = Window.partitionBy(*group).orderBy(centre, order)
    new = (centre - F.lag(centre).over(w)) > gap
    flagged = rows.select("*", F.coalesce(new, F.lit(True)).cast("int").alias("__new"))
    return flagged.select("*", (F.sum("__new").over(w) - 1).cast("int").alias("cluster")).drop("__new")


def free_bands(merged: DataFrame, group: list[str], start: str, end: str, page_end: float) -> DataFrame:
    """The complement of merged intervals within 0..page_end, per group."""
    w = Window.partitionBy(*group).orderBy(start)
    before = merged.select(*group, F.coalesce(F.lag(end).over(w), F.lit(0.0)).alias("top"), F.col(start).alias("bottom"))
    after = merged.groupBy(*group).agg(F.max(end).alias("top")).select(*group, "top", F.lit(page_end).alias("bottom"))
    return before.unionByName(after).where("bottom > top")


def owned_text(blocks: DataFrame, owned: DataFrame, replaceable: DataFrame) -> DataFrame:
    """Blocks that must not move: not nearly covered by owned boxes, not half covered by replaceable ones."""

    def without(rows: DataFrame, boxes: DataFrame, least: float) -> DataFrame:
        r = _named(boxes, "r_", "bbox").withColumnsRenamed({"doc_id": "r_doc", "page_idx": "r_page"})
        same = (F.col("doc_id") == F.col("r_doc")) & (F.col("page_idx") == F.col("r_page"))
        return rows.join(r, same & (G.overlap_of(F.col("bbox"), F.col("r_bbox")) >= least), "left_anti")

    return without(without(blocks, owned, 0.95), replaceable, 0.5)
