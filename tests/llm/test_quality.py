from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkfolio.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, source string, gid string, d2 int, n_words string, kept int"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def texts():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    out = []
    for _ in range(700):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 12))]
        out.append("\n".join(lines))
    for t in out[:60]:
        out.append(t + "\n" + t[: len(t) // 2] + "\n\n" + t)
    out += ["\n".join(["same line"] * n) for n in range(8)] + ["a b c d e " * n for n in range(6)] + ["a " * 30, "x y z\x0bx y z\x1cx y z"]
    out += [None, "", " ", "\n \t\n", "# * $ % & | < >", "🤣 ß nbsp  ", "w" * 100000, "one two three four five six seven eight nine ten " * 6000]
    junk = [" ".join(rng.choice(vocab) + rng.choice(["***", "###", "&&&"]) for _ in range(60)) for _ in range(6)]
    return out, junk


@pytest.fixture(scope="module")
def judged(spark):
    plain, junk = texts()
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else "t", "g", 1, "n", 1) for i, t in enumerate(plain + junk)]
    rows += [rows[0]] * 3 + [(None, plain[1], "en", "s", "g", 1, "n", 1), (5000, plain[2], "zz", "rare", "g", 1, "n", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    return rows, len(plain), df, quality.judge(df).collect()


def test_counts_against_brute_force(judged):
    rows, _, _, got = judged
    want = sorted((str(r[0]), *plain_counts(r[1])) for r in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_the_rest_stays(judged):
    _, n, _, got = judged
    passed = [r for r in got if not r.base_failed and r.doc_id is not None]
    assert not any(r.kept for r in passed if n <= r.doc_id < 5000)
    plain = [r for r in passed if r.doc_id < n - 40 or r.doc_id == 5000]
    assert sum(r.kept for r in plain) >= 0.99 * len(plain) and next(r for r in plain if r.doc_id == 5000).kept


def test_filter_agrees_and_keeps_columns(judged):
    _, _, df, got = judged
    left = quality.kept_documents(df)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_estimate_resists_contamination(spark):
    rng = np.random.default_rng(3)
    spread = np.array([[0.04, 0.02, 0, 0], [0.02, 0.09, 0.01, 0], [0, 0.01, 0.05, 0], [0, 0, 0, 0.06]])
    good = rng.multivariate_normal([1.7, 0.5, 0.4, 0.3], spread, 3000)
    bad = rng.multivariate_normal([3.0, 4.0, 1.5, 1.5], spread / 10, 600)
    rows = [("en", "s", *map(float, x)) for x in np.vstack([good, bad])]
    df = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double")
    groups, estimate = quality.estimates(df)
    r = estimate.collect()
    assert groups.count() == len(r) == 1
    assert np.allclose(r[0].m, [1.7, 0.5, 0.4, 0.3], atol=0.05)
    f = np.zeros((4, 4))
    f[np.tril_indices(4)] = r[0].f
    assert np.allclose(f @ f.T, spread + np.diag(np.square(quality.LEAST_SPREAD)), atol=0.03)
    x = np.vstack([good, bad])
    y = np.linalg.solve(f, (x - np.array(r[0].m)).T)
    named = df.selectExpr("false as failed", "*")
    d2 = [q.d2 for q in quality._judged(named, groups, estimate).collect()]
    assert np.allclose(sorted(d2), sorted((y * y).sum(axis=0)))


def plain_step(x, m, k):
    """One concentration step in numpy: exact order of distances, the last row by the part that is needed."""
    d2 = np.einsum("ij,ij->i", x - m, np.linalg.solve(k, (x - m).T).T)
    w, need = np.zeros(len(x)), quality.SUBSET * len(x)
    order = np.argsort(d2, kind="stable")
    w[order[: int(need)]] = 1
    if need > int(need):
        w[order[int(need)]] = need - int(need)
    m = (w[:, None] * x).sum(axis=0) / need
    c = (w[:, None, None] * (x - m)[:, :, None] * (x - m)[:, None, :]).sum(axis=0) / need
    return m, quality.consistency() * c + np.diag(np.square(quality.LEAST_SPREAD))


def plain_estimate(x, starts=60, seed=1):
    """The least determinant over many random starts."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        some = x[rng.choice(len(x), size=max(6, len(x) // 10), replace=False)]
        m, k = some.mean(axis=0), np.cov(some.T, bias=True) + np.diag(np.square(quality.LEAST_SPREAD))
        last = np.inf
        for _ in range(60):
            m, k = plain_step(x, m, k)
            now = np.linalg.slogdet(k)[1]
            if last - now < 1e-9:
                break
            last = now
        if best is None or now < best[0]:
            best = now, m, k
    return best


def groups_of_statistics():
    """Groups like those of texts: clean ones, mostly zero ones, ones with a cluster apart, ones in two halves."""
    rng = np.random.default_rng(5)
    plain = rng.normal([1.6, 0.2, 0.1, 0.1], [0.2, 0.1, 0.1, 0.1], (300, 4))
    zero = np.abs(rng.normal(0, 0.2, (400, 4))) * (rng.random((400, 4)) < [1.0, 0.1, 0.15, 0.2])
    apart = np.vstack([rng.normal(0.5, 0.3, (250, 4)), rng.normal(3, 0.3, (60, 4))])
    halves = np.vstack([rng.normal(0, 0.1, (120, 4)), rng.normal([0.8, 0, 0, 0], 0.1, (100, 4))])
    skew = rng.normal(0, 1, (200, 1)) * [0.5, 0.4, 0.1, 0.0] + rng.normal(0, 0.05, (200, 4))
    return [plain, zero, apart, halves, skew]


def test_verdicts_against_a_brute_force_estimate(spark):
    data = groups_of_statistics()
    rows = [(False, "en", f"s{g}", *map(float, v)) for g, x in enumerate(data) for v in x]
    df = spark.createDataFrame(rows, "failed boolean, lang string, source string, x0 double, x1 double, x2 double, x3 double").repartition(3)
    groups, estimate = quality.estimates(df)
    judged = quality._judged(df, groups, estimate).collect()
    point, size = quality.chi_square_point(quality.TAIL), {}
    for r in groups.join(estimate, "gid").collect():
        f = np.zeros((4, 4))
        f[np.tril_indices(4)] = r.f
        size[r.source] = np.linalg.slogdet(f @ f.T)[1]
    rejected = 0
    for g, x in enumerate(data):
        least, m, k = plain_estimate(x)
        assert size[f"s{g}"] <= least + 0.02, g
        d2 = np.einsum("ij,ij->i", x - m, np.linalg.solve(k, (x - m).T).T)
        ours = {(r.x0, r.x1, r.x2, r.x3): r for r in judged if r.source == f"s{g}"}
        for v, d in zip(x, d2):
            r = ours[tuple(map(float, v))]
            assert abs(r.d2 - d) <= 0.05 * d + 0.05, (g, r.d2, d)
            if abs(d - point) > 0.06 * point:
                assert r.kept == (d <= point)
                rejected += not r.kept
    assert rejected >= 60


def test_determinant_never_rises(spark):
    rows = [(f"g{g}", *map(float, v)) for g, x in enumerate(groups_of_statistics()) for v in x]
    df = spark.createDataFrame(rows, "gid string, x0 double, x1 double, x2 double, x3 double")
    now, sizes = quality._starts(df, True), {}
    for _ in range(5):
        now = quality.written(quality._moments(quality._nearest(df, now, True)), "t", 1)
        for r in now.collect():
            sizes.setdefault((r.gid, r.start), []).append(r.size)
    assert len(sizes) == 4 * 5
    # Distances are compared by bins of half a percent.
    assert all(b <= a + 0.005 for x in sizes.values() for a, b in zip(x, x[1:]))


def test_small_groups_are_judged_by_their_language_then_by_all(spark):
    rng = np.random.default_rng(2)
    row = lambda lang, source, at: (False, lang, source, *map(float, rng.normal(at, 0.05, 4)))
    rows = [row("en", "big", 0.5) for _ in range(200)] + [row("en", "few", 0.5) for _ in range(5)] + [row("fr", "few", 0.5) for _ in range(5)]
    rows += [row("en", "few", 4), row("fr", "few", 4)]
    df = spark.createDataFrame(rows, "failed boolean, lang string, source string, x0 double, x1 double, x2 double, x3 double")
    groups, estimate = quality.estimates(df)
    assert sorted(r.gid for r in groups.collect()) == ['{"level":0,"lang":"en","source":"big"}', '{"level":1,"lang":"en"}', '{"level":2}'] and estimate.count() == 3
    judged = quality._judged(df, groups, estimate).collect()
    assert sorted((r.lang, r.source) for r in judged if not r.kept) == [("en", "few"), ("fr", "few")]
    alone = df.where("lang = 'fr'")
    groups, estimate = quality.estimates(alone)
    assert groups.count() == 0 and all(r.kept for r in quality._judged(alone, groups, estimate).collect())


def test_chi_square():
    assert abs(quality.chi_square_point(0.05) - 9.4877) < 1e-3 and abs(quality.chi_square_tail(13.277) - 0.01) < 1e-5


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judge(empty).collect() == [] and quality.kept_documents(empty).collect() == []
