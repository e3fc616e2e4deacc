"""Translation units: reading order, context, assembly, ledger, cache, checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions import literals as L
from sparkfolio.functions import text as X
from sparkfolio.operators import terms as M
from sparkfolio.thresholds import T

#: Kinds of units in the order in which they are read at one place.
RANKS = {"heading": 0, "body": 1, "cell": 2}


def united(*tables: DataFrame) -> DataFrame:
    """Units of several kinds as one table; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def reading_order(units: DataFrame) -> DataFrame:
    """``units(doc_id, unit_id, kind, page_idx, y, x)`` with ``position`` by page, place, kind and id."""
    rank = F.element_at(F.create_map(*[F.lit(v) for kv in RANKS.items() for v in kv]), F.col("kind"))
    w = Window.partitionBy("doc_id").orderBy("page_idx", "y", "x", rank, "unit_id")
    return units.select("*", (F.row_number().over(w) - 1).alias("position"))


def with_context(units: DataFrame, text: str = "text", order: str = "position", group: str = "doc_id") -> DataFrame:
    """The texts before and after each unit, of whatever kind and page."""
    w = Window.partitionBy(group).orderBy(order)
    return units.select("*", F.lag(text).over(w).alias("previous"), F.lead(text).over(w).alias("next"))


def fragments(units: DataFrame, pieces: Column) -> DataFrame:
    """One row per piece of a unit, with the pieces or units before and after it."""
    flat = units.select("*", F.posexplode(pieces).alias("fragment", "piece"))
    w = Window.partitionBy("doc_id", "unit_id").orderBy("fragment")
    return flat.select(
        "*", F.coalesce(F.lag("piece").over(w), F.col("previous")).alias("before"), F.coalesce(F.lead("piece").over(w), F.col("next")).alias("after")
    )


def assembled(members: DataFrame, key: list[str], y: str = "y", x: str = "x", text: str = "text") -> DataFrame:
    """Texts of a group in the order of their places, with spaces unless there is Chinese, Japanese or Korean among them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(y, x, text))), lambda m: m[text])
    cjk = F.bool_or(F.col(text).rlike(X.CJK_WIDE))
    joined = members.groupBy(*key).agg(ordered.alias("__t"), cjk.alias("__c"))
    out = F.when(F.col("__c"), X.join_cjk_gaps(F.array_join("__t", ""))).otherwise(F.array_join("__t", " "))
    return joined.select(*key, out.alias("text"))


def masked(units: DataFrame, text: str = "text") -> DataFrame:
    return units.select("*", L.mask_udf(F.col(text)).alias("__m")).select(*units.columns, "__m.masked", "__m.literals")


def counters(cells: DataFrame, key: list[str], target: str) -> DataFrame:
    """Numbers of units, of those translated and left, of locked ones and of literals in the others."""
    locked, wanted = X.is_locked(F.col("text")), X.needs_translation(F.col("text"), target)
    flagged = cells.select(*key, locked.alias("locked"), (wanted & ~locked).alias("translated"), F.size(L.numbers(F.col("text"))).alias("literals"))
    return flagged.groupBy(*key).agg(
        F.count("*").alias("units"), F.count_if("translated").alias("translated"), F.count_if(~F.col("translated")).alias("preserved"),
        (F.count_if("locked") + F.coalesce(F.sum(F.when(~F.col("locked"), F.col("literals"))), F.lit(0))).alias("protected"),
    )


def ledger(units: DataFrame) -> DataFrame:
    """One nested row per document: pages, and in them the units in order; numbers count from one."""
    entry = F.struct((F.col("position") + 1).alias("order"), "unit_id", "kind", "source", "target", "translated")
    by_page = units.groupBy("doc_id", (F.col("page_idx") + 1).alias("page")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return by_page.groupBy("doc_id").agg(F.lit(1).alias("schema_version"), F.array_sort(F.collect_list(F.struct("page", "entries"))).alias("pages"))


def fingerprint(content: Column, **settings: str) -> Column:
    """SHA-256 of the settings in the order of their names and of the content's own SHA-256."""
    named = [F.lit(f"{k}={settings[k]}") for k in sorted(settings)]
    return F.sha2(F.concat_ws("\x1f", *named, F.sha2(content, 256)), 256)


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order)
    return rows.select("*", F.row_number().over(w).alias("__at")).where("__at = 1").drop("__at")


def cached(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results by fingerprint: what the cache has, and what is computed once for each fingerprint it lacks.

    A cache entry without a result is a miss.
    """
    valid = cache.where("result is not null").dropDuplicates(["fingerprint"])
    wanted = requests.select("fingerprint").distinct()
    hits = wanted.join(valid, "fingerprint").select("fingerprint", "result", F.lit(True).alias("hit"))
    fresh = compute(wanted.join(valid, "fingerprint", "left_anti")).select("fingerprint", "result", F.lit(False).alias("hit"))
    return requests.join(hits.unionByName(fresh), "fingerprint")


def renumbered(pages: DataFrame, insertions: DataFrame) -> DataFrame:
    """Physical page of each source page and of the pages inserted after it.

    ``pages(doc_id, page_idx)``, ``insertions(doc_id, page_idx, extra)``; an
    inserted page has ``part`` above 0.
    """
    both = pages.join(insertions, ["doc_id", "page_idx"], "left").select("doc_id", "page_idx", F.coalesce("extra", F.lit(0)).alias("extra"))
    w = Window.partitionBy("doc_id").orderBy("page_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("extra") + 1).over(w), F.lit(0))
    placed = both.select("doc_id", "page_idx", "extra", start.alias("s"))  # before rows are multiplied
    return placed.select("doc_id", "page_idx", F.explode(F.sequence(F.lit(0), F.col("extra"))).alias("part"), "s").select(
        "doc_id", "page_idx", "part", (F.col("s") + F.col("part")).cast("long").alias("physical_idx")
    )


def partition_faults(parts: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Keys that parts do not hold exactly once: ``lacking``, ``doubled`` or ``foreign``."""
    n = parts.groupBy(*key).agg(F.count("*").alias("n"))
    w = wanted.select(*key).distinct().withColumn("__w", F.lit(True))
    code = F.when(F.col("n").isNull(), "lacking").when(F.col("__w").isNull(), "foreign").when(F.col("n") > 1, "doubled")
    return n.join(w, key, "full").select(*key, code.alias("fault")).where("fault is not null")


def same_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys that only one side has, with the side."""
    left = a.exceptAll(b).withColumn("side", F.lit("left"))
    return left.unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def output_quality(pairs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``pairs(unit_id, source, translated, target)``: script counts and the list of failures.

    An output is ``unchanged`` also if its whole compacted text is nearly its
    source's.  With ``terms``, each one that a source requires and its output
    lacks is a failure ``term_missing:term_id``.
    """
    said = F.coalesce("translated", F.lit(""))
    latin, cjk = X.count(said, X.LATIN), X.count(said, X.CJK_BASIC)
    lang = F.substring(F.lower("target"), 1, 2)
    wide, source = lang.isin("zh", "ja", "ko"), X.nfkc(F.col("source"))
    other = (wide & (X.count(source, X.LATIN) >= T.qa_latin)) | ((lang == "en") & (X.count(source, X.CJK_BASIC) >= T.qa_cjk))
    compact = lambda c: X.casefold(F.regexp_replace(c, r"(?U)\s+", ""))
    near = L.similar_udf(F.when(other, compact(source)), compact(X.nfkc(said)), F.lit(T.qa_similarity))
    same = X.needs_translation(F.col("source"), F.col("target")) & (X.collapsed(F.col("source")) == X.collapsed(said))
    rules = F.array(
        F.when(F.trim(said) == "", "no_text"),
        F.when(wide & (latin >= T.qa_latin) & (cjk < T.qa_latin_cjk), "target_script_missing"),
        F.when((lang == "en") & (cjk >= T.qa_cjk) & (latin < T.qa_cjk_latin), "target_script_missing"),
        F.when(same | near, "unchanged"),
    )
    failures = F.filter(rules, lambda r: r.isNotNull())
    if terms is not None:
        required = M.requirements(pairs.select("unit_id", "source", F.col("target").alias("language")), terms, "source")
        required = required.withColumn("required_target", X.key(X.nfkc(F.col("required_target"))))
        lacking = M.missing(pairs.select("unit_id", X.key(X.nfkc(said)).alias("said")), required, "said")
        listed = F.transform(F.array_sort(F.collect_set("term_id")), lambda t: F.concat(F.lit("term_missing:"), t.cast("string")))
        pairs = pairs.join(lacking.groupBy("unit_id").agg(listed.alias("lacking")), "unit_id", "left")
        failures = F.concat(failures, F.coalesce("lacking", F.array().cast("array<string>")))
    return pairs.select(
        "unit_id", latin.cast("int").alias("latin"), cjk.cast("int").alias("cjk"), F.array_join(failures, ",").alias("failures"), (F.size(failures) == 0).alias("passed"),
    )


def layout_issues(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """What a layout payload breaks of its contract: one row per fault, ``doc_id, page_idx, idx, code``.

    ``pages(doc_id, page_idx, width, height, angle)``, ``blocks(doc_id,
    page_idx, idx, x0, y0, x1, y1, text)``.
    """
    none = F.lit(None).cast("int").alias("idx")
    fault = lambda df, cond, code, idx: df.where(cond).select("doc_id", "page_idx", idx, F.lit(code).alias("code"))
    i = F.col("idx").cast("int").alias("idx")
    doubled = pages.groupBy("doc_id", "page_idx").agg(F.count("*").alias("n"))
    orphan = blocks.join(pages.select("doc_id", "page_idx").distinct(), ["doc_id", "page_idx"], "left_anti")
    ok = "coalesce(x1 > x0 and y1 > y0 and not isnan(x0) and not isnan(y0) and not isnan(x1) and not isnan(y1), false)"
    return (
        fault(pages, "page_idx < 0", "negative_page", none)
        .unionByName(fault(doubled, "n > 1", "doubled_page", none))
        .unionByName(fault(pages, "not coalesce(width > 0 and height > 0, false)", "page_size", none))
        .unionByName(fault(pages, "coalesce(angle % 90 <> 0, true)", "angle", none))
        .unionByName(fault(blocks, f"not {ok}", "bbox", i))
        .unionByName(fault(blocks, "trim(coalesce(text, '')) = ''", "blank_text", i))
        .unionByName(fault(orphan, F.lit(True), "no_page", i))
    )


def spec_issues(elements: DataFrame) -> DataFrame:
    """Rules of a layout specification over its elements: one row per broken rule.

    ``elements(doc_id, page_idx, element_id, type, x0, y0, x1, y1, page_width,
    page_height, text, font_size, min_font_size, align, color)``.
    """
    slack = T.spec_bounds
    rules = F.array(
        F.when(F.trim(F.coalesce("element_id", F.lit(""))) == "", "no_id"),
        F.when(F.count("*").over(Window.partitionBy("doc_id", "element_id")) > 1, "doubled_id"),
        F.when(~F.coalesce(F.col("type").isin("text", "image", "cover"), F.lit(False)), "type"),
        F.when(~F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.lit(False)), "bbox"),
        F.when((F.col("x0") < -slack) | (F.col("y0") < -slack) | (F.col("x1") > F.col("page_width") + slack) | (F.col("y1") > F.col("page_height") + slack), "out_of_page"),
        F.when((F.col("type") == "text") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "no_text"),
        F.when(F.col("min_font_size") > F.col("font_size"), "font_order"),
        F.when(~F.coalesce(F.col("align"), F.lit("left")).isin("left", "center", "right", "justify"), "align"),
        F.when(F.col("color").isNotNull() & X.color(F.col("color")).isNull(), "color"),
    )
    listed = elements.select("doc_id", "page_idx", "element_id", rules.alias("rules"))
    return listed.select("doc_id", "page_idx", "element_id", F.explode(F.filter("rules", lambda r: r.isNotNull())).alias("code"))


def missing_pages(source: DataFrame, spec: DataFrame) -> DataFrame:
    """Pages that a specification leaves out, and those that its source does not have."""
    key = ["doc_id", "page_idx"]
    a, b = source.select(*key).distinct(), spec.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("fault", F.lit("not_in_spec")).unionByName(b.join(a, key, "left_anti").withColumn("fault", F.lit("not_in_source")))


def stage_timings(events: DataFrame) -> DataFrame:
    """``events(job, stage, ts)``: milliseconds from the first to the last event of each stage, and over all."""
    ms = lambda: F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1000).cast("long").alias("ms")
    return events.groupBy("job", "stage").agg(ms()).unionByName(events.groupBy("job").agg(F.lit("total").alias("stage"), ms()))


def markdown(blocks: DataFrame) -> DataFrame:
    """Each document as Markdown: page titles, headings by their type, furniture left out."""
    from sparkfolio.operators.semantics import canonical, is_furniture_text

    kind = canonical(F.col("type"))
    line = F.when(kind == "title", F.concat(F.lit("# "), "text")).when(kind == "section_heading", F.concat(F.lit("### "), "text")).otherwise(F.col("text"))
    said = blocks.where(~is_furniture_text(kind)).select("doc_id", "page_idx", "n", line.alias("line"))
    by_page = said.groupBy("doc_id", "page_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda b: b["line"]), "\n\n").alias("body"))
    titled = by_page.select("doc_id", "page_idx", F.concat(F.lit("## Page "), (F.col("page_idx") + 1).cast("string"), F.lit("\n\n"), F.col("body")).alias("page"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "page"))), lambda p: p["page"]), "\n\n")
    return titled.groupBy("doc_id").agg(whole.alias("markdown"))
