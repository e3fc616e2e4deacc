"""Texts as positioned lines: a layout that follows from a text alone.

Line ``n`` of a document stands on page ``n div 40`` at a place and with a
width that its number and length give.  Five lines make a region; the first
and last line of a page are its header and footer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions import geometry as G

# Fixed values of the layout: page size, lines of a page and of a region, margins, advances.
PAGE_WIDTH, PAGE_HEIGHT, PAGE_LINES, REGION_LINES = 612.0, 552.0, 40, 5
MARGIN, INDENT, ADVANCE, LEADING, INK, LONGEST = 36, 6, 6, 12, 10, 86


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n, page_idx, text, type, bbox``: one block per line; a null text has none."""
    raw = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    x0, y0 = MARGIN + INDENT * (F.col("n") % 3), MARGIN + LEADING * (F.col("n") % PAGE_LINES)
    placed = raw.select(
        "doc_id", "n", F.floor(F.col("n") / PAGE_LINES).cast("int").alias("page_idx"), "text",
        G.box(x0, y0, x0 + ADVANCE * F.least(F.length("text"), F.lit(LONGEST)), y0 + INK).alias("bbox"),
    )
    last = F.max("n").over(Window.partitionBy("doc_id", "page_idx"))
    kind = F.when(F.col("n") % PAGE_LINES == 0, "page_header").when(F.col("n") == last, "page_footer").otherwise("text")
    return placed.select("doc_id", "n", "page_idx", "text", kind.alias("type"), "bbox")


def regions(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_idx, region_idx, type, confidence, bbox``: the union of each band of five lines."""
    band = F.floor(F.col("n") / REGION_LINES).cast("int").alias("region_idx")
    kinds = F.when(F.col("region_idx") % 7 == 3, "paragraph_title").when(F.col("region_idx") % 11 == 5, "table").otherwise("text")
    merged = blocks.groupBy("doc_id", "page_idx", band).agg(G.union(F.col("bbox")).alias("bbox"))
    confidence = F.lit(0.5) + (F.col("region_idx") % 5) / 10
    return merged.select("doc_id", "page_idx", "region_idx", kinds.alias("type"), confidence.alias("confidence"), "bbox")


#: The same two tables in SQL, as common table expressions over ``documents``.
LINES_SQL = """
raw as (
  select doc_id, unnest(range(len(a)))::int as n, unnest(a) as text
  from (select doc_id, string_split(text, chr(10)) as a from documents)
), placed as (
  select doc_id, n, (n // 40)::int as page_idx, text,
    (36 + 6 * (n % 3))::double as x0, (36 + 12 * (n % 40))::double as y0,
    (36 + 6 * (n % 3) + 6 * least(length(text), 86))::double as x1, (36 + 12 * (n % 40) + 10)::double as y1
  from raw
), lines as (
  select *, case when n % 40 = 0 then 'page_header'
    when n = max(n) over (partition by doc_id, page_idx) then 'page_footer' else 'text' end as type
  from placed where x1 > x0
), merged as (
  select doc_id, page_idx, (n // 5)::int as region_idx, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1
  from lines group by all
), regions as (
  select doc_id, page_idx, region_idx,
    case when region_idx % 7 = 3 then 'paragraph_title' when region_idx % 11 = 5 then 'table' else 'text' end as type,
    0.5::double + (region_idx % 5)::double / 10::double as confidence, x0, y0, x1, y1
  from merged
)
"""
