"""Profiles of documents and pages, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions import geometry as G
from sparkfolio.functions import text as X
from sparkfolio.functions.literals import matched_length_udf
from sparkfolio.thresholds import T


def page_signals(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page_idx, text_chars, image_coverage)`` with flags: has text, is an image, both."""
    text, image = F.col("text_chars") > 0, F.col("image_coverage") >= T.image_page_coverage
    kind = F.when(text & image, "searchable_scan").when(image, "image").when(text, "native").otherwise("blank")
    return pages.select("*", text.alias("has_text"), image.alias("is_image"), kind.alias("classification"))


def document_profile(pages: DataFrame, sample_pages: int | None = None) -> DataFrame:
    """Kind and route of each document from its pages.

    A document is dominated by images if at least half its pages are; then it
    is a scan, searchable if all image pages have text.
    """
    p = page_signals(pages if sample_pages is None else pages.where(F.col("page_idx") < sample_pages))
    both = F.col("has_text") & F.col("is_image")
    agg = p.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if("has_text").alias("native_text_pages"), F.count_if("is_image").alias("scan_pages"),
        F.count_if(both).alias("searchable_scan_pages"), F.round(F.avg("image_coverage"), 4).alias("average_image_coverage"),
    )
    dominated = (F.col("scan_pages") > 0) & (2 * F.col("scan_pages") >= F.col("pages"))
    kind = (
        F.when(F.col("pages") == 0, "empty")
        .when(dominated & (F.col("searchable_scan_pages") == F.col("scan_pages")), "searchable_scan")
        .when(dominated, "image_scan")
        .when(F.col("native_text_pages") > 0, "born_digital")
        .otherwise("unknown")
    )
    route = F.when(F.col("kind") == "born_digital", "direct").otherwise("recognize")
    return agg.select("*", kind.alias("kind")).select("*", route.alias("route"))


def page_quality(boxes: DataFrame) -> DataFrame:
    """``boxes(doc_id, page_idx, bbox, confidence)`` to the quality of each page and whether it looks turned."""
    tall = G.height(F.col("bbox")) >= T.tall_ratio * G.width(F.col("bbox"))
    wide = G.width(F.col("bbox")) >= T.tall_ratio * G.height(F.col("bbox"))
    q = boxes.groupBy("doc_id", "page_idx").agg(
        F.count("*").alias("boxes"), F.median("confidence").alias("mid"),
        F.avg(tall.cast("double")).alias("vertical"), F.avg(wide.cast("double")).alias("horizontal"),
    )
    score = T.score_confidence * F.col("mid") + T.score_horizontal * F.col("horizontal")
    suspicious = (
        (F.col("boxes") >= T.orientation_boxes)
        & (F.col("vertical") >= T.orientation_vertical)
        & ((F.col("mid") < T.orientation_confidence) | (F.col("horizontal") < T.orientation_horizontal))
    )
    r = lambda c: F.round(c, 4)
    return q.select(
        "doc_id", "page_idx", "boxes", r("mid").alias("median_confidence"), r("vertical").alias("vertical_ratio"),
        r("horizontal").alias("horizontal_ratio"), r(score).alias("score"), suspicious.alias("suspicious"),
    )


def best_orientation(attempts: DataFrame) -> DataFrame:
    """The attempt with the best score per page, of equal ones the first; turned ones count only if the upright is suspicious."""
    whole = Window.partitionBy("doc_id", "page_idx")
    upright = F.bool_or((F.col("angle") == 0) & F.col("suspicious")).over(whole)
    ranked = attempts.select("*", upright.alias("__turn")).where((F.col("angle") == 0) | F.col("__turn"))
    w = whole.orderBy(F.desc("score"), F.array_position(F.array(F.lit(0), F.lit(90), F.lit(270)), F.col("angle")))
    best = ranked.select("*", F.row_number().over(w).alias("__at")).where("__at = 1")
    return best.select("doc_id", "page_idx", "angle", "score", F.col("suspicious").alias("failed"))


def script_profile(docs: DataFrame, text: str = "text") -> DataFrame:
    n = X.script_counts(F.col(text))
    return docs.select("doc_id", *[c.cast("int").alias(k) for k, c in n.items()])


def language(docs: DataFrame, text: str = "text", fallback: str = "en") -> DataFrame:
    return docs.select("doc_id", X.detect_language(F.col(text), fallback).alias("language"))


def layer_matches(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """Per page of ``(doc_id, page_idx, text)`` on either side: characters expected, extracted and matched, letters and digits only.

    Whole texts are matched block by block; equal ones never reach Python.  A
    page that one side lacks has no text there.
    """
    side = lambda df, name: df.select("doc_id", "page_idx", X.compact(F.col("text")).alias(name))
    both = side(expected, "e").join(side(extracted, "x"), ["doc_id", "page_idx"], "full")
    both = both.select("doc_id", "page_idx", F.coalesce("e", F.lit("")).alias("e"), F.coalesce("x", F.lit("")).alias("x"))
    matched = F.when(F.col("e") == F.col("x"), F.length("e")).when((F.col("e") == "") | (F.col("x") == ""), 0).otherwise(matched_length_udf("e", "x"))
    return both.select("doc_id", "page_idx", F.length("e").alias("expected"), matched.alias("matched"), F.length("x").alias("extracted"))


def layer_verification(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page_idx, expected, matched, extracted)`` in characters: coverage and duplication, and what fails."""
    some = F.col("expected") > 0
    by_page = pages.select(
        "*", (some & (F.try_divide("matched", "expected") < T.layer_coverage)).alias("thin"),
        (some & (F.try_divide("extracted", "expected") > T.layer_duplication)).alias("doubled"), (~some & (F.col("extracted") > 0)).alias("stray"),
    )
    sums = by_page.groupBy("doc_id").agg(
        F.sum("expected").alias("expected"), F.round(F.least(F.try_divide(F.sum("matched"), F.sum("expected")), F.lit(1.0)), 6).alias("coverage"), F.round(F.try_divide(F.sum("extracted"), F.sum("expected")), 6).alias("duplication"),
        F.count_if("thin").alias("thin_pages"), F.count_if("doubled").alias("doubled_pages"), F.count_if("stray").alias("stray_pages"),
    )
    passed = (F.col("thin_pages") == 0) & (F.col("doubled_pages") == 0) & (F.col("stray_pages") == 0)
    return sums.where("expected > 0 or stray_pages > 0").drop("expected").select("*", passed.alias("passed"))


def size_faults(source: DataFrame, output: DataFrame) -> DataFrame:
    """Pages that one side lacks or whose sizes differ, of ``(doc_id, page_idx, width, height)``."""
    o = output.withColumnsRenamed({"width": "o_width", "height": "o_height"})
    both = source.join(o, ["doc_id", "page_idx"], "full")
    far = (F.abs(F.col("width") - F.col("o_width")) > T.page_points) | (F.abs(F.col("height") - F.col("o_height")) > T.page_points)
    code = F.when(F.col("o_width").isNull(), "missing").when(F.col("width").isNull(), "extra").when(far, "size")
    return both.select("doc_id", "page_idx", code.alias("fault")).where("fault is not null")


def bilingual_map(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """How a bilingual document lays out its pages: ``mode, logical_idx, physical_idx, x_from``.

    Side by side if as many pages are at least T.bilingual_width times as wide;
    interleaved if there are twice as many of the same size; else neither.
    """
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("width").alias("w"))
    s = sources.groupBy("doc_id").agg(F.count("*").alias("m"), F.max("width").alias("sw"))
    mode = (
        F.when((F.col("n") == F.col("m")) & (F.col("w") >= T.bilingual_width * F.col("sw")), "side_by_side")
        .when((F.col("n") == 2 * F.col("m")) & (F.abs(F.col("w") - F.col("sw")) <= T.bilingual_points), "interleaved")
    )
    found = n.join(s, "doc_id").select("doc_id", "m", mode.alias("mode")).where("mode is not null")
    logical = found.select("doc_id", "mode", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("logical_idx"))
    side = F.col("mode") == "side_by_side"
    return logical.select(
        "doc_id", "mode", "logical_idx", F.when(side, F.col("logical_idx")).otherwise(2 * F.col("logical_idx") + 1).alias("physical_idx"),
        F.when(side, 0.5).otherwise(0.0).alias("x_from"),
    )


def first_pages(lines: DataFrame, text: Column, pages: int = T.language_pages, chars: int = T.language_chars) -> DataFrame:
    """The beginning of each document as text, for whatever looks at no more than that."""
    ordered = F.array_sort(F.collect_list(F.struct("n", text.alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")
    return lines.where(F.col("page_idx") < pages).groupBy("doc_id").agg(F.substring(joined, 1, chars).alias("text"))
