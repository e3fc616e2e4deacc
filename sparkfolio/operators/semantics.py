"""Semantic types of layout elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.fixed import CAPTIONS_AND_TABLES, FORMULA, FURNITURE_IMAGE, FURNITURE_TEXT, LABELS, VISUAL
from sparkfolio.functions import text as X

NOT_SOURCE = (*FURNITURE_TEXT, *FURNITURE_IMAGE, *FORMULA, *VISUAL, *CAPTIONS_AND_TABLES)
HEADINGS = ("title", "section_heading")


def canonical(label: Column) -> Column:
    """The canonical type of a raw label; an unknown one stays what it is, a null one is text."""
    raw = F.translate(F.lower(F.trim(label)), "- ", "__")
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.element_at(known, raw), F.nullif(raw, F.lit("")), F.lit("text"))


def is_furniture_text(kind: Column) -> Column:
    return kind.isin(*FURNITURE_TEXT)


def is_furniture(kind: Column) -> Column:
    return kind.isin(*FURNITURE_TEXT, *FURNITURE_IMAGE)


def is_formula(kind: Column) -> Column:
    return kind.isin(*FORMULA)


def is_visual(kind: Column) -> Column:
    return kind.isin(*VISUAL)


def is_source_text(kind: Column) -> Column:
    """Whether text of this type is translated; of unknown types it is."""
    return ~kind.isin(*NOT_SOURCE)


def effective(kind: Column, text: Column) -> Column:
    """Plain text that reads like a numbered heading is one."""
    return F.when((kind == "text") & X.is_numbered_heading(X.nfkc(text)), "section_heading").otherwise(kind)


def preserved_pages(elements: DataFrame) -> DataFrame:
    """``doc_id, page_idx`` of pages kept pixel by pixel: an image or chart, no source text and no table."""
    kind = canonical(F.col("type"))
    return (
        elements.groupBy("doc_id", "page_idx")
        .agg(
            F.bool_or(kind.isin("image", "chart")).alias("visual"),
            F.bool_or(is_source_text(kind)).alias("said"),
            F.bool_or(kind == "table").alias("tabular"),
        )
        .where("visual and not said and not tabular")
        .select("doc_id", "page_idx")
    )


def disposition(kind: Column, bbox: Column, preserved: Column) -> Column:
    """Why a block is or is not put into the source layer; the first reason that holds."""
    return (
        F.when(bbox.isNull(), "malformed")
        .when(preserved, "visual_page")
        .when(is_furniture(kind), "furniture")
        .when(is_formula(kind), "formula")
        .when(is_visual(kind) | kind.isin("table", "table_text", "table_caption", "figure_caption"), "visual_or_table")
        .when(~is_source_text(kind), "not_source")
        .otherwise("source")
    )


def with_fallback(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Regions, and blocks of those types that no region of their page has."""
    named = lambda df: df.withColumn("type", canonical(F.col("type")))
    r, b = named(regions), named(blocks)
    missing = b.join(r.select("doc_id", "page_idx", "type").distinct(), ["doc_id", "page_idx", "type"], "left_anti")
    return r.select("doc_id", "page_idx", "type", "bbox").unionByName(missing.select("doc_id", "page_idx", "type", "bbox"))
