"""Terminology: exact targets, requirements by pattern, what a translation misses.

Terms are a table the user gives: ``term_id, source_term, required_target,
language, exact_source``.  Exact terms join by their folded text.  Patterns
are found by tokens: a term's first token is an equality key, and only rows
that share it are tested for the whole term, so no row meets every term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions import text as X


def folded(text: Column) -> Column:
    return F.lower(X.collapsed(text))


def language_matches(wanted: Column, target: Column) -> Column:
    return F.lower(target).startswith(F.lower(wanted))


def exact_targets(units: DataFrame, terms: DataFrame, source: str = "text") -> DataFrame:
    """``unit_id, term_id, required_target`` for units that are a term and nothing else."""
    t = terms.select("term_id", "required_target", F.col("language").alias("t_language"), folded(F.col("source_term")).alias("k"))
    u = units.select("unit_id", "language", folded(F.col(source)).alias("k"))
    found = u.join(t, "k").where(language_matches(F.col("t_language"), F.col("language")))
    return found.groupBy("unit_id").agg(F.min_by(F.struct("term_id", "required_target"), "term_id").alias("t")).select("unit_id", "t.*")


def requirements(units: DataFrame, terms: DataFrame, source: str = "text") -> DataFrame:
    """``unit_id, term_id, required_target`` of the terms that a unit has, from the beginning of a word on."""
    first = lambda c: F.get(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 0)
    t = terms.select("term_id", "required_target", F.col("language").alias("t_language"), folded(F.col("source_term")).alias("term"), first(F.col("source_term")).alias("head"))
    # What is compared is made once for each term and unit, not for each pair of them.
    plain = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^\p{L}\p{N}]", " "))
    t = t.where("head is not null").select("*", plain(F.col("term")).alias("at"))
    u = units.select("unit_id", "language", folded(F.col(source)).alias("said"))
    u = u.select("*", plain(F.col("said")).alias("bounded"))
    words = F.array_distinct(F.regexp_extract_all("said", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    one = ~F.col("term").rlike(r"[^\p{L}\p{N}]")
    # Terms of one word may be the beginning of a word: their heads are joined by prefixes of their length.
    lengths = t.where(one).select(F.length("head").alias("n")).distinct().agg(F.collect_set("n")).first()[0]
    u = u.select("*", words.alias("words"))
    heads = F.flatten(F.transform("words", lambda w: F.array(w, *[F.substring(w, 1, n) for n in sorted(lengths)])))
    # Only ids and heads are multiplied; texts meet the few terms that share a head with them.
    keyed = u.select("unit_id", "language", F.explode(F.array_distinct(heads)).alias("head"))
    near = keyed.join(t, "head").where(language_matches(F.col("t_language"), F.col("language")))
    both = near.select("unit_id", "term_id", "required_target", "term", "at").distinct().join(u.select("unit_id", "said", "bounded"), "unit_id")
    found = F.col("bounded").contains(F.col("at")) & F.col("said").contains(F.col("term"))
    return both.where(found).select("unit_id", "term_id", "required_target").distinct()


def missing(units: DataFrame, required: DataFrame, target: str) -> DataFrame:
    """Requirements whose target a translation does not have."""
    both = required.join(units.select("unit_id", F.lower(target).alias("said")), "unit_id")
    return both.where(~F.coalesce(F.col("said").contains(F.lower("required_target")), F.lit(False))).select("unit_id", "term_id", "required_target")


def checked_terms(text: Column, wanted: list[str], forbidden: list[str]) -> Column:
    """Whether a text has all wanted terms and none of the forbidden ones."""
    ok = F.lit(True)
    for w in wanted:
        ok = ok & F.contains(F.lower(text), F.lit(w.lower()))
    for w in forbidden:
        ok = ok & ~F.contains(F.lower(text), F.lit(w.lower()))
    return ok


def instruction(required: DataFrame) -> DataFrame:
    """One line of instruction per unit that lists its terms in order."""
    listed = F.array_sort(F.collect_list(F.struct("term_id", "required_target")))
    names = F.array_join(F.transform(listed, lambda t: t["required_target"]), "; ")
    return required.groupBy("unit_id").agg(F.concat(F.lit("Use these terms: "), names).alias("instruction"))
