"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Each text's counts come from array functions on its own row.  Two rules reject
outright; what passes them is judged against its language and source: the
transformed statistics of a group have a minimum-covariance-determinant
estimate of place and spread, and a document too far from it by its
Mahalanobis distance is rejected.

Three of the four statistics are zero in most documents, so the covariance of a
subset has no inverse; the estimate is the regularised one, whose spread is the
subset's and a fixed target.  It has several deterministic starts: medians and
quartile ranges, all rows, the half nearest the medians, and the directions
from them.  From each, concentration steps are taken: the rows nearest by the
estimate so far give the next one, whose determinant is no larger, until none
falls any more; the least determinant is the group's.  Quantiles within groups
are read off histograms, rows of the last bin count by the part of them that is
needed, and moments are sums, so that no group, however large, is ever in one
place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import WORD, col, drop_written, fresh, pinned, written

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
SYMBOLS = "[#*$%&|<>]"
#: Part of a group that the estimate rests on, most concentration steps, least rows of a group of its own.
SUBSET, STEPS, MIN_GROUP = 0.75, 30, 50
#: Target that is added to the spread of a subset: mean word length (log), symbols, repeated lines, repeated words.
#: The last three are zero in most documents, so that their own spread says nothing about what is far.
LEAST_SPREAD = (0.13, 0.20, 0.15, 0.20)
#: Chance that a document of a normal group is rejected.
TAIL = 1e-5
#: Groups up to which their estimates are broadcast.
BROADCAST_GROUPS = 10_000
#: Bins of a unit of the logarithm of a squared distance, and of a least spread.
DISTANCE_BINS, VALUE_BINS = 200, 20
#: Change of the determinant's logarithm that bins of this width can make: steps that change it less are the last.
STABLE = 1 / DISTANCE_BINS
P = len(LEAST_SPREAD)


def counts(docs: DataFrame, text_col: str) -> tuple[DataFrame, list[str]]:
    """``docs`` and its counts, with their names: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    names = fresh(docs, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "__text", "__words", "__lines", "__windows", "__sorted", "__places")
    n_words, word_chars, n_symbols, n_lines, n_dup, n_repeat, text, words, lines, windows, order, places = names
    c, long = F.col, lambda x: x.cast("long")
    base = docs.select("*", F.coalesce(col(text_col), F.lit("")).alias(text))
    base = base.select("*", F.regexp_extract_all(c(text), F.lit(WORD), F.lit(0)).alias(words))
    has_word = lambda x: x.rlike(WORD)
    base = base.select("*", F.filter(F.split(c(text), "\n"), has_word).alias(lines))
    # A window is known by the hash of its words' hashes.
    hashed = F.transform(c(words), lambda w: F.xxhash64(w))
    base = base.withColumn(words, hashed)
    body = F.slice(c(words), 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    window = F.transform(body, lambda w, i: F.xxhash64(w, *[F.get(c(words), i + k) for k in range(1, WINDOW)]))
    base = base.select("*", window.alias(windows))
    again = F.size(F.array_distinct(windows)) < F.size(windows)
    placed = F.sort_array(F.transform(c(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.select("*", F.when(again, placed).alias(order))
    same = lambda x, j: F.coalesce(x["h"] == F.get(c(order), j)["h"], F.lit(False))
    twice = F.filter(c(order), lambda x, j: same(x, j - 1) | same(x, j + 1))
    base = base.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias(places))
    # A word counts once: each place adds the words up to the next one, a window at most.
    reach = F.transform(c(places), lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(c(places), j + 1), p + WINDOW) - p))
    gaps = F.length(F.regexp_replace(c(text), WORD, ""))
    out = base.select(
        *[col(x) for x in docs.columns],
        long(F.size(words)).alias(n_words),
        long(F.length(text) - gaps).alias(word_chars),
        long(F.length(text) - F.length(F.regexp_replace(c(text), SYMBOLS, ""))).alias(n_symbols),
        long(F.size(lines)).alias(n_lines),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias(n_dup),
        F.coalesce(F.aggregate(reach, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long").alias(n_repeat),
    )
    return out, names[:6]


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def vector(n_words: Column, word_chars: Column, n_symbols: Column, n_lines: Column, n_dup: Column, n_repeat: Column) -> list[Column]:
    """The transformed statistics: logarithms of a length and a rate, arcsine roots of two shares."""
    share = lambda a, b: F.asin(F.sqrt(F.least(a / F.greatest(b, F.lit(1)), F.lit(1.0))))
    return [
        F.log((word_chars + 1) / (n_words + 1)), F.log1p(20 * n_symbols / (word_chars + 1)),
        share(n_dup, n_lines), share(n_repeat, n_words),
    ]


def chi_square_tail(x: float, p: int = P) -> float:
    """Chance that a chi-square with an even number ``p`` of degrees is above ``x``."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi_square_point(tail: float, p: int = P) -> float:
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, p) > tail else (low, mid)
    return high


def consistency() -> float:
    """Factor that makes the spread of the nearest part of normal rows that of all."""
    return SUBSET / (1 - chi_square_tail(chi_square_point(1 - SUBSET), P + 2))


def _joined(rows: DataFrame, groups: DataFrame, small: bool, on=("gid",)) -> DataFrame:
    return rows.join(F.broadcast(groups) if small else groups, list(on))


def _distance(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the squared distance by the means ``m`` and the factors ``f`` (lower triangle, by row)."""
    solved: list[Column] = []
    f = lambda i, j: F.col("f")[i * (i + 1) // 2 + j]
    keep = list(rows.columns)
    for i in range(P):
        y = F.col(f"x{i}") - F.col("m")[i]
        for j in range(i):
            y = y - f(i, j) * F.col(f"__y{j}")
        rows = rows.select("*", (y / f(i, i)).alias(f"__y{i}"))
        solved.append(F.col(f"__y{i}") * F.col(f"__y{i}"))
    total = solved[0]
    for s in solved[1:]:
        total = total + s
    return rows.select(*keep, total.alias(name))


def _factored(groups: DataFrame, spread) -> DataFrame:
    """``gid, start, m, f, size`` from means ``m0..`` and a function that gives each entry of the spread as a column.

    ``f`` is the lower triangle of the spread's root, by row, ``size`` the logarithm of its determinant.
    """
    at = {}
    for i in range(P):
        for j in range(i + 1):
            v = spread(i, j)
            for k in range(j):
                v = v - F.col(f"f{i}{k}") * F.col(f"f{j}{k}")
            v = F.sqrt(F.greatest(v, F.lit(LEAST_SPREAD[i] ** 2 * 1e-3))) if i == j else v / F.col(f"f{j}{j}")
            groups = groups.select("*", v.alias(f"f{i}{j}"))
            at[i, j] = F.col(f"f{i}{j}")
    size = 2 * sum((F.log(F.col(f"f{i}{i}")) for i in range(1, P)), F.log(F.col("f00")))
    return groups.select("gid", "start", F.array(*[F.col(f"m{i}") for i in range(P)]).alias("m"), F.array(*at.values()).alias("f"), size.alias("size"))


def _ridge(spread) -> object:
    """``spread(i, j)`` and the target."""
    return lambda i, j: spread(i, j) + (LEAST_SPREAD[i] ** 2 if i == j else 0.0)


def _medians(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges per group, by histogram."""
    width = [s / VALUE_BINS for s in LEAST_SPREAD]
    bins = F.array(*[F.struct(F.lit(i).alias("d"), F.floor(F.col(f"x{i}") / width[i]).alias("b")) for i in range(P)])
    n = rows.select("gid", F.explode(bins).alias("e")).groupBy("gid", "e.d", "e.b").agg(F.count("*").alias("n"))
    along = Window.partitionBy("gid", "d").orderBy("b")
    n = n.select("*", F.sum("n").over(along).alias("upto"), F.sum("n").over(Window.partitionBy("gid", "d")).alias("all"))
    at = lambda q, i: F.min(F.when((F.col("d") == i) & (F.col("upto") >= q * F.col("all")), F.col("b"))) * width[i]
    found = n.groupBy("gid").agg(
        *[(at(0.5, i) + width[i] / 2).alias(f"m{i}") for i in range(P)],
        *[((at(0.75, i) - at(0.25, i)) / 1.349).alias(f"s{i}") for i in range(P)],
    )
    found = found.select("*", F.lit(0).alias("start"))
    return _factored(found, _ridge(lambda i, j: F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)))


def _starts(rows: DataFrame, small: bool) -> DataFrame:
    """The estimates that concentration begins from: four a group."""
    middle = written(_medians(rows), "medians", 1)
    everything = rows.select("*", F.lit(1).alias("start"), F.lit(1.0).alias("w"), *[F.lit(0.0).alias(f"c{i}") for i in range(P)])
    half = _nearest(rows, middle, small, 0.5).withColumn("start", F.lit(2))
    # Directions from the medians: what lies far counts no more than what lies near.
    far = _distance(_joined(rows, middle, small), "d2")
    unit = F.sqrt(F.greatest(F.col("d2"), F.lit(1e-12)))
    way = [(F.col(f"x{i}") - F.col("m")[i]) / unit for i in range(P)]
    signs = far.select("gid", "m", *[v.alias(f"v{i}") for i, v in enumerate(way)])
    sums = signs.groupBy("gid").agg(
        F.first("m").alias("m"), *[F.avg(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    )
    sums = sums.select("*", F.lit(3).alias("start"), *[F.col("m")[i].alias(f"m{i}") for i in range(P)])
    directions = _factored(sums, _ridge(lambda i, j: F.col(f"c{i}{j}") * P))
    out = written(middle.unionAll(_moments(everything)).unionAll(_moments(half)).unionAll(directions), "starts", 1)
    drop_written(middle)
    return out


def _nearest(rows: DataFrame, estimate: DataFrame, small: bool, part: float = SUBSET) -> DataFrame:
    """The rows of each group with the least distances, with weights ``w`` that add up to ``part`` of it.

    Distances are compared by bins; the rows of the last one have equal weights.
    ``c0..`` is the place that they were measured from.
    """
    far = _distance(_joined(rows, estimate, small), "d2")
    far = far.select("*", F.floor(F.log(F.col("d2") + 1e-12) * DISTANCE_BINS).alias("bin"))
    n = far.groupBy("gid", "start", "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("gid", "start")
    n = n.select("*", (F.sum("n").over(group.orderBy("bin")) - F.col("n")).alias("before"), (part * F.sum("n").over(group)).alias("need"))
    last = n.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
    last = last.select("gid", "start", F.col("bin").alias("last"), ((F.col("need") - F.col("before")) / F.col("n")).alias("share"))
    near = _joined(far, last, small, ("gid", "start")).where(F.col("bin") <= F.col("last"))
    return near.select(
        "gid", "start", *[f"x{i}" for i in range(P)], F.when(F.col("bin") == F.col("last"), F.col("share")).otherwise(1.0).alias("w"),
        *[F.col("m")[i].alias(f"c{i}") for i in range(P)],
    )


def _moments(rows: DataFrame) -> DataFrame:
    """Means and spread of each group's weighted rows, about the place ``c0..``; the target is added to what they show."""
    x = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(P)]
    w = F.col("w")
    sums = rows.groupBy("gid", "start").agg(
        F.sum("w").alias("w"), *[F.first(f"c{i}").alias(f"c{i}") for i in range(P)], *[F.sum(w * x[i]).alias(f"a{i}") for i in range(P)],
        *[F.sum(w * x[i] * x[j]).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)],
    )
    mean = lambda i: F.col(f"a{i}") / F.col("w")
    sums = sums.select("*", *[(F.col(f"c{i}") + mean(i)).alias(f"m{i}") for i in range(P)])
    scale = consistency()
    return _factored(sums, _ridge(lambda i, j: (F.col(f"q{i}{j}") / F.col("w") - mean(i) * mean(j)) * scale))


def concentrated(rows: DataFrame, small: bool) -> DataFrame:
    """``gid, m, f`` of ``rows(gid, x0..)``: the start whose steps end at the least determinant."""
    now = _starts(rows, small)
    for _ in range(STEPS):
        after = written(_moments(_nearest(rows, now, small)), "estimate", 1)
        fall = after.join(now.select("gid", "start", F.col("size").alias("old")), ["gid", "start"]).agg(F.max(F.abs(F.col("old") - F.col("size")))).first()[0]
        drop_written(now)
        now = after
        if fall is None or fall < STABLE:
            break
    best = now.groupBy("gid").agg(F.min_by(F.struct("m", "f"), F.struct("size", "start")).alias("e")).select("gid", "e.*")
    out = written(best, "estimate", 1)
    drop_written(now)
    return out


def estimates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rows(lang, source, x0..)``: groups ``(lang, source, gid)`` and estimates ``(gid, m, f)``.

    A pair of language and source with fewer than MIN_GROUP rows is judged by
    all rows of its language, and where those are too few, by all rows there
    are; only if these are fewer than MIN_GROUP is there no estimate, and
    nothing is rejected.
    """
    n = written(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), "pairs", 1)
    small = n.count() <= BROADCAST_GROUPS
    whole = F.sum("n").over(Window.partitionBy())
    of_lang = F.sum("n").over(Window.partitionBy("lang"))
    key = lambda level, *c: F.to_json(F.struct(F.lit(level).alias("level"), *c))
    own, lang, all_ = key(0, "lang", "source"), key(1, "lang"), key(2)
    gid = F.when(F.col("n") >= MIN_GROUP, own).when(F.col("of_lang") >= MIN_GROUP, lang).when(F.col("whole") >= MIN_GROUP, all_)
    groups = n.select("*", of_lang.alias("of_lang"), whole.alias("whole")).select("lang", "source", gid.alias("gid"))
    groups = written(groups.where("gid is not null"), "groups", 1)
    # A row counts in its pair's estimate and in those of its language and of all rows, where some pair needs them.
    needed = F.broadcast(groups.select("gid").distinct()) if small else groups.select("gid").distinct()
    counted = n.select("lang", "source", F.explode(F.array(own, lang, all_)).alias("gid")).join(needed, "gid", "left_semi")
    counted = written(counted, "counted", 1)
    named = _grouped(rows, counted, small).select("gid", *[f"x{i}" for i in range(P)])
    estimate = concentrated(named, small)
    drop_written(n)
    drop_written(counted)
    return groups, estimate


def _grouped(rows: DataFrame, groups: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    g = groups.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[c for c in groups.columns if c not in ("lang", "source")])
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    return rows.join(F.broadcast(g) if small else g, same, how).drop("__lang", "__source")


def _judged(rows: DataFrame, groups: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows(failed, lang, source, x0..)`` with ``d2`` and ``kept``."""
    both = groups.join(estimate, "gid").drop("gid")
    small = groups.count() <= BROADCAST_GROUPS
    far = _distance(_grouped(rows, both, small, "left"), "d2")
    near = F.coalesce(F.col("d2") <= chi_square_point(TAIL), F.lit(True))
    return far.drop("m", "f").select("*", pinned(~F.col("failed") & near).alias("kept"))


def _prepared(docs: DataFrame, text_col: str, lang_col: str, source_col: str, more: list[Column]) -> DataFrame:
    found, names = counts(docs, text_col)
    n = [F.col(x) for x in names]
    return found.select(
        *more, *[c.alias(x) for c, x in zip(n, ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"))],
        base_failed(n[0], n[5]).alias("failed"), col(lang_col).cast("string").alias("lang"), col(source_col).cast("string").alias("source"),
        *[v.alias(f"x{i}") for i, v in enumerate(vector(*n))],
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts and verdict per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2``.

    A null text has no words and fails.  Null languages and sources are groups
    like others.  Estimates rest on documents that pass the base rules;
    ``distance2`` is null without an estimate.  Repeated rows are repeated
    observations; an empty table gives an empty one.
    """
    rows = written(_prepared(docs, text_col, lang_col, source_col, [col(id_col).alias("doc_id")]), "counts")
    groups, estimate = estimates(rows.where("not failed"))
    judged = _judged(rows, groups, estimate)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("failed").alias("base_failed"), "kept", F.round("d2", 6).alias("distance2"),
    )


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that pass, columns unchanged.

    The counts are written next to the documents, so they are made once; the
    estimates read only them, and each document is then judged where it lies,
    so that texts are never shuffled.
    """
    row = F.struct(*[col(c) for c in docs.columns]).alias("row")
    rows = written(_prepared(docs, text_col, lang_col, source_col, [row]), "counts")
    groups, estimate = estimates(rows.where("not failed"))
    return _judged(rows, groups, estimate).where("kept").select("row.*")
