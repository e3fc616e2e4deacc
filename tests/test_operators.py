"""Golden examples and properties of what SQL cannot express."""

from __future__ import annotations

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfolio.functions import geometry as G
from sparkfolio.functions import literals as L
from sparkfolio.functions import text as X
from sparkfolio.operators import layout as Y
from sparkfolio.operators import profile as P
from sparkfolio.operators import regions as R
from sparkfolio.operators import semantics as S
from sparkfolio.operators import tables as B
from sparkfolio.operators import terms as M
from sparkfolio.operators import units as U
from sparkfolio.sources import files

PIECES = st.lists(st.sampled_from(["99.5 %", "A-001", "ISO", "2024-01-31", "x = 3", "[[1]]", "【2】", "word", " ", "，", "12,5 mg", "中A", "very", "é", "\n", "10 kg", "[", "]]"]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_restoring_undoes_masking(text):
    masked, values = L.mask(text)
    assert L.restore(masked, values) == (text, None)
    assert L.slots_in(masked, values) == list(range(len(values)))


def test_slots_survive_what_translators_do_to_brackets():
    masked, values = L.mask("Batch A-001 has 99.5 % purity")
    assert masked == "Batch [[0]] has [[1]] purity" and values == ["A-001", "99.5 %"]
    for said in ("[[1]] of [[0]]", "[ 1 ] of 【0】", "［［1］］ of [[ 0 ]]", "[[1|99 %]] of [[0|x]]"):
        assert L.restore(said, values) == ("99.5 % of A-001", None)
    assert L.restore("A-001 has [[1]]", values) == ("A-001 has 99.5 %", None)
    assert L.restore("[[0]] only", values)[1] == "missing:1"
    assert L.restore("[[0]] [[0]] [[1]]", values)[1] == "doubled:0"
    assert L.restore("[[0]] [[1]] [[7]]", values)[1] == "unknown slot"
    assert L.expose(masked, values) == "Batch [[0|A-001]] has [[1|99.5 %]] purity"
    assert L.literals("ISO and GMP", frozenset({"GMP"})) == ["GMP"]


def test_many_slots_are_told_apart():
    text = " ".join(f"A-{i}" for i in range(1500))
    masked, values = L.mask(text)
    assert len(values) == 1500 and L.restore(masked, values) == (text, None)
    assert L.slots_in("[[100]]", values) == [100]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["[[1]]", "[[23]]", "word", " ", ",", "。", "long" * 30, "; "]), max_size=60).map("".join))
def test_chunks_make_up_the_text_and_keep_bounds(text):
    out = L.packed(text, slots=3, chars=50)
    assert "".join(out) == text
    assert all(len(c) <= 50 and c.count("[[") <= 3 for c in out)


def test_similarity_reads_whole_texts():
    """Runs of their own letters keep the match of texts this long fast."""
    start = "".join(chr(0x4E00 + i) for i in range(20_000))
    a, b = start + "abcd", start + "axyz"
    assert L.matched_length(a, b) == 20_001 and L.matched_length(a, a) == 20_004
    assert L.similarity(a, b) == 2 * 20_001 / (2 * 20_004)
    assert L.similarity(a, b, 20_000) == 1.0 and L.matched_length(a, b, 20_000) == 20_000


def test_similarity():
    assert L.similarity("abc", "abc") == 1.0 and L.similarity("abcd", "bcde") == 0.75 and L.similarity(None, "x") is None
    assert L.matched_length("hello world", "hello there") == 7


def test_text_functions(spark):
    rows = [(1, "ＡＢＣ　１２"), (2, "中文 字 abc"), (3, "第一车间 and 二 车间"), (4, "exten sion of informa tion treat ment"), (5, "3.2  Method"), (6, "日本語のテキスト"), (7, "한국어 텍스트"), (8, "化学反应方程式"), (9, "only latin")]
    df = spark.createDataFrame(rows, "i int, t string")
    one = lambda c: {r.i: r.v for r in df.select("i", c.alias("v")).collect()}
    t = F.col("t")
    assert one(X.nfkc(t))[1] == "ABC 12"
    assert one(X.join_cjk_gaps(t))[2] == "中文字 abc"
    assert one(X.ordinal_digits(t))[3] == "第1车间 and 二 车间"
    assert one(X.clean_extracted(t))[4] == "exten sion of information treatment"
    assert one(X.heading_order(t))[5] == "3.2 Method"
    assert [one(X.detect_language(t))[i] for i in (6, 7, 8, 9)] == ["ja", "ko", "zh", "en"]
    assert one(X.casefold(F.lit("Straße")))[1] == "strasse"
    assert one(X.repair_confusions(F.lit("00S X00S O0S")))[1] == "OOS X00S OOS"
    assert one(X.is_locked(F.lit("99.5 %")))[1] and one(X.is_locked(F.lit("A-001")))[1] and not one(X.is_locked(F.lit("plain words")))[1]
    assert one(X.collapse_acronyms(F.lit("QA QA is very very good")))[1] == "QA is very very good"


def test_labels_and_pages(spark):
    labels = ["Content", "doc-title", "FIGURE", None, "", "something new", "table_text"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, type string")
    got = [r.v for r in df.select("i", S.canonical(F.col("type")).alias("v")).orderBy("i").collect()]
    assert got == ["text", "title", "image", "text", "text", "something_new", "table_text"]
    assert [r.v for r in df.select("i", S.is_source_text(S.canonical(F.col("type"))).alias("v")).orderBy("i").collect()] == [True, True, False, True, True, True, False]


def test_boxes(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 2.0), (2, 3.0, 1.0, 1.0, 5.0), (3, float("nan"), 0.0, 1.0, 1.0), (4, 0.0, 0.0, float("inf"), 1.0)], "i int, a double, b double, c double, d double")
    bbox = G.box(*[F.col(c) for c in "abcd"])
    got = {r.i: r for r in df.select("i", bbox.alias("v"), G.area(bbox).alias("area"), G.polygon_box(F.array(F.array("a", "b"), F.array("c", "d"))).alias("p")).collect()}
    assert got[1].area == 8.0 and got[2].v is None and got[3].v is None and got[4].v is None
    assert tuple(got[2].p) == (1.0, 1.0, 3.0, 5.0)
    sides = spark.range(1).select(G.is_horizontal(F.lit(1.0), F.lit(0.0), F.lit(0)).alias("a"), G.is_horizontal(F.lit(1.0), F.lit(0.0), F.lit(90)).alias("b"), G.clockwise(F.lit(90)).alias("c"), G.right_angle(F.lit(45)).alias("d")).first()
    assert tuple(sides) == (True, False, 270, None)


def test_each_target_goes_to_one_region_like_a_greedy_matching(spark):
    rng = random.Random(5)
    boxes = lambda n: [(x := rng.uniform(0, 80), y := rng.uniform(0, 80), x + rng.uniform(5, 30), y + rng.uniform(5, 30)) for _ in range(n)]  # noqa: E731,F841
    rows, targets = [], []
    for page in range(20):
        rows += [(1, page, i, *b) for i, b in enumerate(boxes(6))]
        targets += [(1, page, i, *b) for i, b in enumerate(boxes(9))]
    make = lambda data, name: spark.createDataFrame(data, f"doc_id long, page_idx int, {name} int, x0 double, y0 double, x1 double, y1 double").select("doc_id", "page_idx", name, G.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("bbox"))
    got = {(r.page_idx, r.n): r.region_idx for r in R.assigned(make(rows, "region_idx"), make(targets, "n")).collect()}
    pairs = []
    for _, p, i, *a in rows:
        for _, q, j, *b in targets:
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if p == q and w > 0 and h > 0:
                area = lambda v: (v[2] - v[0]) * (v[3] - v[1])
                pairs.append((round(w * h / min(area(a), area(b)) + h / min(a[3] - a[1], b[3] - b[1]), 9), i, p, j))
    want: dict = {}
    for _, i, p, j in sorted(pairs, reverse=True):
        want.setdefault((p, j), i)
    assert got == want


def test_tables():
    rows = B.structured_rows("<TABLE><tr><td></td></tr><tr><th rowspan=2>Name<th colspan=2>Values</tr><tr><td>min<td>max<tr><td>a &amp; b<td>1<br>2<td>3</table>")
    cells = B.infer_headers(B.grid(rows))
    assert cells == [
        (0, 0, 2, 1, "Name", True), (0, 1, 1, 2, "Values", True), (1, 1, 1, 1, "min", True), (1, 2, 1, 1, "max", True),
        (2, 0, 1, 1, "a & b", False), (2, 1, 1, 1, "1\n2", False), (2, 2, 1, 1, "3", False),
    ]
    assert [c[4] for c in B.grid(B.structured_rows("| a | b\\|c |\n|---|:-:|\n| 1 | 2 |"))] == ["a", "b|c", "1", "2"]
    assert B.grid([]) == [] and B.structured_rows(None) == [] and B.structured_rows("no table") == []
    assert B.width_hint(B.html_rows("<tr><td>1<td>2<tr><td>1<td>2<td>3")) == 3
    assert B._span("500") == 100 and B._span("x") == 1 and B._span("0") == 1
    clamped = B.grid(B.html_rows("<tr><td rowspan=9>a<td>b<tr><td>c"))
    assert clamped[0][:4] == (0, 0, 2, 1) and clamped[2][:2] == (1, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 4)), min_size=1, max_size=5), max_size=6))
def test_grid_cells_never_overlap(shape):
    cells = B.grid([[["x", a, b, False] for a, b in row] for row in shape])
    seen = [(r + i, c + j) for r, c, a, b, _, _ in cells for i in range(a) for j in range(b)]
    assert len(seen) == len(set(seen)) and all(r < len(shape) for r, _ in seen)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(1, 60), max_size=40), st.floats(0, 100), st.floats(60, 200))
def test_pages_are_filled_in_order(sizes, first, more):
    out = B.pages(sizes, first, more)
    assert out == sorted(out) and len(out) == len(sizes)
    for p in set(out):
        held = [s for s, q in zip(sizes, out) if q == p]
        assert sum(held) <= (first if p == 0 else more) + 1e-9 or len(held) == 1


def test_signature_tables_stay_images(spark):
    df = spark.createDataFrame([("<table><tr><td>Signature</td><td>Date</td></tr></table>",), ("<table><tr><td>1</td></tr></table>",), ("",)], "content string").withColumn("k", F.monotonically_increasing_id())
    got = B.extracted(df, ["k"]).groupBy("k").agg(F.max("preserve_as_image").alias("i"), F.max("unreconstructable").alias("u")).orderBy("k").collect()
    assert [(r.i, r.u) for r in got] == [(True, False), (False, False), (False, True)]


def test_visual_lines():
    assert B.line_clusters([(10, 10), (12, 10), (30, 10), (11, 10), (31, 10)]) == [0, 0, 1, 0, 1] and B.line_clusters([]) == []


def test_rhythm_and_continuation():
    tops = Y.stacked([(0, 20), (0, 20), (0, 20)], 0, 100, [])
    assert tops == [0, 31.25, 62.5]
    assert Y.stacked([(0, 60), (0, 60)], 0, 100, []) == [0, None]
    assert Y.stacked([(0, 20), (0, 20)], 0, 100, [(15, 40)])[0] >= 40
    words = " ".join(["word"] * 400)
    out = Y.continued(["short", words, "end"], 200, 120, 60)
    assert out[0] == (0, 0, "short") and " ".join(p for _, i, p in out if i == 1) == words and out[-1][2] == "end"
    assert [p for p, *_ in out] == sorted(p for p, *_ in out)


def test_terms(spark):
    terms = spark.createDataFrame([(1, "Batch", "批", "zh", False), (2, "batch record", "批记录", "zh", False), (3, "QA", "质量", "zh", True)], "term_id int, source_term string, required_target string, language string, exact_source boolean")
    units = spark.createDataFrame([(1, "The batch  record", "zh-CN"), (2, "batches", "zh"), (3, "qa", "zh"), (4, "rebatch", "zh"), (5, "Batch", "en")], "unit_id int, text string, language string")
    got = {(r.unit_id, r.term_id) for r in M.requirements(units, terms).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (3, 3)}
    assert [(r.unit_id, r.required_target) for r in M.exact_targets(units, terms).collect()] == [(3, "质量")]
    said = spark.createDataFrame([(1, "批次"), (2, None)], "unit_id int, said string")
    required = M.requirements(units, terms)
    assert {(r.unit_id, r.term_id) for r in M.missing(said, required, "said").collect()} == {(1, 2), (2, 1)}
    assert {r.unit_id: r.instruction for r in M.instruction(required).collect()}[1] == "Use these terms: 批; 批记录"


def test_output_quality_sees_near_copies_and_missing_terms(spark):
    han, latin = "".join(chr(0x4E00 + i) for i in range(60)), "abcdefghijklmnop"
    rows = [
        (1, han + latin, "X" + (han + latin)[1:], "en"),
        (2, han + latin, han[:30] + latin * 4, "en"),
        (3, "The batch record of this product", "Le dossier de ce produit est ici", "ja"),
        (4, "The batch record of this product", "Le dossier de ce produit est ici", "ko-KR"),
        (5, "The batch record of this product", "这个产品的批 记录", "zh"),
        (6, "The batch record of this product", "这个产品的文件", "zh"),
        (7, "The batch record of this product", None, "zh"),
    ]
    pairs = spark.createDataFrame(rows, "unit_id int, source string, translated string, target string")
    terms = spark.createDataFrame([(1, "batch", "批", "zh"), (2, "batch record", "批记录", "zh")], "term_id int, source_term string, required_target string, language string")
    got = {r.unit_id: (r.failures, r.passed) for r in U.output_quality(pairs, terms).collect()}
    assert got == {1: ("unchanged", False), 2: ("", True), 3: ("target_script_missing", False), 4: ("target_script_missing", False), 5: ("", True), 6: ("term_missing:1,term_missing:2", False), 7: ("no_text,term_missing:1,term_missing:2", False)}
    assert {r.unit_id: r.failures for r in U.output_quality(pairs).collect()}[6] == ""


def test_cache_computes_each_miss_once(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "fingerprint string")
    cache = spark.createDataFrame([("a", "old"), ("c", None)], "fingerprint string, result string")
    seen = []
    out = U.cached(asked, cache, lambda m: seen.append(sorted(r[0] for r in m.collect())) or m.withColumn("result", F.lit("new")))
    assert sorted(map(tuple, out.collect())) == [("a", "old", True), ("b", "new", False), ("b", "new", False), ("c", "new", False)] and seen == [["b", "c"]]


def test_profile_kinds(spark):
    pages = [(1, 0, 100, 0.0), (2, 0, 0, 0.9), (3, 0, 50, 0.9), (4, 0, 0, 0.0), (5, 0, 10, 0.1), (5, 1, 0, 0.8), (6, 0, 10, 0.0), (6, 1, 5, 0.0), (6, 2, 0, 0.5)]
    df = spark.createDataFrame(pages, "doc_id int, page_idx int, text_chars int, image_coverage double")
    got = {r.doc_id: (r.kind, r.route) for r in P.document_profile(df).collect()}
    assert got == {1: ("born_digital", "direct"), 2: ("image_scan", "recognize"), 3: ("searchable_scan", "recognize"), 4: ("unknown", "recognize"), 5: ("image_scan", "recognize"), 6: ("born_digital", "direct")}


def test_html_blocks_and_layout_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<nav>Menu</nav><h1>Title</h1><p>One<p>Two <b>bold</b><script>x()</script><!-- no --><footer>F</footer>"), (2, None)], "page_id long, html string")
    assert [(r.type, r.text) for r in files.html_blocks(pages).orderBy("n").collect()] == [("page_header", "Menu"), ("title", "Title"), ("text", "One"), ("text", "Two bold"), ("page_footer", "F")]
    (tmp_path / "a.json").write_text('{"provider": "p", "pages": [{"page_size": [10, 20], "angle": 90}], "blocks": [{"page_idx": 0, "bbox": [0, 0, 1, 1], "text": "t", "type": "text"}], "regions": []}')
    p, r, b = files.layout_tables(files.read_layout(spark, str(tmp_path)), "path")
    assert [tuple(x)[1:] for x in p.collect()] == [(0, 10.0, 20.0, 270)] and r.count() == 0 and b.first().text == "t"


def test_guarded_files(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"no"), ("c.txt", b"%PDF-"), ("d.pdf", b""), ("e.pdf", b"%PDF-" + b"x" * 100)):
        (tmp_path / name).write_bytes(data)
    got = {r.path[-5]: r.fault for r in files.read_files(spark, str(tmp_path), most=50).collect()}
    assert got == {"a": None, "b": "magic", "c": "suffix", "e": "too_large"}  # Spark's reader has no rows for empty files
    none = spark.createDataFrame([("d.pdf", 0, bytearray())], "path string, length long, content binary")
    assert files.guarded_files(none).first().fault == "empty"


def test_manifest_and_ledger_are_written(spark, tmp_path):
    units = spark.createDataFrame([(1, 0, 0, 7, "body", "a", "b", True), (1, 1, 1, 8, "cell", "c", "d", False)], "doc_id long, page_idx int, position int, unit_id int, kind string, source string, target string, translated boolean")
    nested = U.ledger(units)
    files.write_ledger(nested, str(tmp_path / "l"))
    files.write_manifest(nested.select("doc_id", "schema_version"), str(tmp_path / "m"))
    assert [(r.page, r.order) for r in spark.read.parquet(str(tmp_path / "l/flat")).orderBy("order").collect()] == [(1, 1), (2, 2)]
    assert spark.read.json(str(tmp_path / "m")).first().doc_id == 1


def test_inbox_is_processed_once(spark, tmp_path):
    from pyspark.sql import types as T

    from sparkfolio.streaming import progress

    inbox, schema = tmp_path / "in", T.StructType([T.StructField("x", T.LongType())])
    spark.range(3).select(F.col("id").alias("x")).write.parquet(str(inbox))
    for _ in range(2):
        stream = progress.watched_files(spark, str(inbox), schema)
        progress.run_jobs(stream, lambda b: b.withColumn("y", F.col("x") * 2), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    spark.range(5, 6).select(F.col("id").alias("x")).write.mode("append").parquet(str(inbox))
    progress.run_jobs(progress.watched_files(spark, str(inbox), schema), lambda b: b.withColumn("y", F.col("x") * 2), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.y for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 10]


def test_rules_as_the_results_compared_with_have_them(spark):
    """Expected values from the rules' behaviour, not from our patterns."""
    ask = lambda f, values: [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]
    raw = ["inline_formula", "display-formula", "page no", "image_body", "chart_body", "image_title", "pagenumber", "interline_formula", "title", "doc_title", "paragraph"]
    want = ["inline_equation", "equation", "page_number", "image", "chart", "figure_caption", "page_number", "interline_equation", "title", "title", "paragraph"]
    assert ask(S.canonical, raw) == want
    assert ask(lambda c: S.is_source_text(S.canonical(c)), raw) == [False] * 8 + [True] * 3
    headings = {"3.2方法": True, "1、目的": True, "1. No. of samples": True, "IV. Intro": False, "A. Intro": False, "3.2.5 " + "long label " * 4: True, "4.1 " + "long label " * 3: False, "7 items": False, "1. It ends.": False, "12) Scope:": True, "3.2": False, "1.5 mg": True, "１．目的": True, "1.2345 x": False, "2 . Aim": True}
    assert ask(lambda c: X.is_numbered_heading(X.nfkc(c)), list(headings)) == list(headings.values())
    locked = {"Na2SO4": True, "H2O": True, "C6H12O6": True, "": True, " \n ": True, "2024/1/5": True, "≤ 5.0 mg/mL": True, "A-001": True, "n / a": True, "QA": True, "word": False, "two words": False, "Hello": False, "x1": True, "12\n13": False, "第一": False}
    assert ask(X.is_locked, list(locked)) == list(locked.values())
    assert "Na2SO4" in L.literals("the Na2SO4 in it") and L.literals("标记A项") == ["A"]


def test_restore_is_linear_and_takes_anything():
    import time

    text = " ".join(f"A-{i}" for i in range(20000))
    masked, values = L.mask(text)
    began = time.perf_counter()
    assert L.restore(masked, values) == (text, None) and time.perf_counter() - began < 2
    assert L.restore("\x007\x00 [[0]]", ["x"]) == ("\x007\x00 x", None)
    assert L.restore("[[" + "9" * 6000 + "]]", ["x"])[1] == "unknown slot"
    assert L.restore("x and [[1]]", ["x", "x"]) == ("x and x", None) and L.restore("[[1]]", ["x", "x"])[1] == "missing:0"


def test_values_keep_their_rows(spark):
    from sparkfolio.operators import tables as B

    values = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 5.0)], "t int, x double")
    anchors = spark.createDataFrame([(1, 0, 0.0), (1, 1, 10.0)], "t int, column int, anchor double")
    assert sorted(((r.t, r.x, r.column) for r in B.nearest_anchor(values, anchors, ["t"], F.col("x")).collect()), key=str) == [(1, 5.0, 0), (1, 5.0, 0), (2, 5.0, None)]


def test_the_first_request_stays(spark):
    from sparkfolio.streaming import progress

    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 3, "only")], "fingerprint string, ts int, what string").repartition(3)
    assert sorted(tuple(r) for r in progress.requests_once(df).collect()) == [("a", 1, "first"), ("b", 3, "only")]


def test_layers_are_matched_by_page(spark):
    import difflib

    a = [(1, 0, "The quick brown fox"), (1, 1, "second page " * 9), (2, 0, None), (3, 0, "same")]
    b = [(1, 0, "The brown quick fox"), (1, 1, "second page " * 30), (2, 0, "stray"), (3, 0, "SAME")]
    made = lambda rows: spark.createDataFrame(rows, "doc_id int, page_idx int, text string")
    got = {(r.doc_id, r.page_idx): (r.expected, r.matched, r.extracted) for r in P.layer_matches(made(a), made(b)).collect()}
    plain = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    for (d, p, x), (*_, y) in zip(a, b):
        x, y = plain(x), plain(y)
        assert got[d, p] == (len(x), sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()), len(y))
    out = {r.doc_id: r for r in P.layer_verification(P.layer_matches(made(a), made(b))).collect()}
    assert out[1].doubled_pages == 1 and not out[1].passed and out[2].stray_pages == 1 and not out[2].passed and out[3].passed


def test_tables_are_redrawn_over_pages(spark):
    """A long table, one whose spans hold rows together, and one of a header alone."""
    from sparkfolio.operators.composites import redrawn_tables

    long = [("a", 0, 0, 1, 1, "Item", True), ("a", 0, 1, 1, 1, "Result", True)]
    for r in range(1, 61):
        long += [("a", r, 0, 1, 1, f"B-{r:03d}", False), ("a", r, 1, 1, 1, f"{90 + r / 10:.1f} %", False)]
    tied = [("b", 0, 0, 1, 2, "Both columns", True)]
    for r in range(1, 40, 3):
        tied += [("b", r, 0, 3, 1, f"group {r}", False)] + [("b", r + i, 1, 1, 1, f"value {r + i}", False) for i in range(3)]
    alone = [("c", 0, 0, 1, 1, "Nothing below", True)]
    cells = spark.createDataFrame(long + tied + alone, "t string, row int, column int, row_span int, column_span int, text string, header boolean")
    out = redrawn_tables(cells, ["t"], 400.0, 150.0, 240.0).collect()
    assert Counter((r.t, r.row, r.column) for r in out if not r.header) == Counter(c[:3] for c in long + tied if not c[6])
    for t in "abc":
        mine = [r for r in out if r.t == t]
        parts = sorted({r.part for r in mine})
        assert parts == list(range(len(parts))) and (len(parts) > 1) == (t != "c")
        for part in parts:
            page = [r for r in mine if r.part == part]
            assert {(r.row, r.column) for r in page if r.header} == {c[1:3] for c in long + tied + alone if c[0] == t and c[6]}
            assert max(r.y1 for r in page) <= (150 if part == 0 else 240) + 1e-9 and max(abs(r.x1 - 400) for r in page if r.x1 > 300) < 1e-6
            for p in page:
                for q in page:
                    apart = p.x1 <= q.x0 + 1e-9 or q.x1 <= p.x0 + 1e-9 or p.y1 <= q.y0 + 1e-9 or q.y1 <= p.y0 + 1e-9
                    assert apart or (p.row, p.column) == (q.row, q.column)


def test_redrawn_tables_are_those_of_a_plain_fold(spark):
    """Random grids with spans, gaps, wide, blank and null texts, tables without a key, all in one task and in many, cut by batches anywhere."""
    import math
    import random
    from fractions import Fraction

    from sparkfolio.operators import tables as B
    from sparkfolio.operators.composites import redrawn_tables

    rnd, rows = random.Random(11), []
    for t in range(300):
        high, wide, taken, heads = rnd.randint(1, 60), rnd.randint(1, 5), set(), rnd.choice([0, 1, 2, 70])
        for r in range(high):
            for c in range(wide):
                if (r, c) in taken or rnd.random() < 0.05:
                    continue
                down, across = min(high - r, rnd.choice([1] * 8 + [2, 3, 7])), min(wide - c, rnd.choice([1] * 6 + [2, 3]))
                while any((r + i, c + j) in taken for i in range(down) for j in range(across)):
                    down, across = (down, across - 1) if across > 1 else (down - 1, across)
                taken.update((r + i, c + j) for i in range(down) for j in range(across))
                text = rnd.choice([None, "", "x", "漢字 " * rnd.randint(1, 40), "word " * rnd.randint(1, 60), "a\tb\nccc" * rnd.randint(1, 9), "1" * rnd.randint(1, 90)])
                rows.append((t or None, r, c, down, across, text, r < heads and rnd.random() < 0.9 or None))

    def plain(cells: list[tuple], width: float, first: float, more: float) -> list[tuple]:
        asked = {c: (0, 0) for x in cells for c in range(x[2], x[2] + x[4])}
        for x in cells:
            if x[4] == 1:
                text = x[5] or ""
                asked[x[2]] = tuple(map(max, asked[x[2]], (max(map(len, text.split()), default=0), len(text))))
        demand = [min(190.0, max(token * 4.5 + 5, math.sqrt(chars * 4.5 * 72) * min(3.0, max(1.0, chars / 80)), 34.0)) for _, (token, chars) in sorted(asked.items())]
        cents = [math.floor(d / sum(demand) * width * 100) for d in demand[:-1]]
        cents.append(round(width * 100) - sum(cents))
        left = {c: sum(cents[:i]) for i, c in enumerate(sorted(asked))}
        right = {c: left[c] + w for c, w in zip(sorted(asked), cents)}
        made = []
        for _, r, c, down, across, text, header in sorted(cells, key=lambda x: x[1:4]):
            x0, x1, text_width = left[c], right[c + across - 1], Fraction(9, 2) * sum(2 if ch in "漢字" else 1 for ch in text or "")
            lines = max(1, math.ceil(text_width * 100 / max(x1 - x0 - 500, 900)))
            made.append({"row": r, "column": c, "row_span": down, "header": header, "text": text, "x0": x0 / 100, "x1": x1 / 100, "need": lines * 11.25 + 1.4})
        sizes, reach = B.heights_of(made, 11.25), -1
        groups: list[list[int]] = []
        for r in sorted({i for c in made for i in range(c["row"], c["row"] + c["row_span"])}):
            groups = [*groups[:-1], [*groups[-1], r]] if r <= reach else [*groups, [r]]
            reach = max([reach, *(c["row"] + c["row_span"] - 1 for c in made if c["row"] <= r)])
        head = max((c["row"] for c in made if c["header"]), default=-1)
        top, body = [r for g in groups if g[-1] <= head for r in g], [g for g in groups if g[-1] > head]
        tall = lambda rs: sum(sizes.get(r, 11.25) for r in rs)
        dealt, out = B.pages([tall(g) for g in body], first - tall(top), more - tall(top)), []
        for part in sorted(set(dealt)) or [0]:
            y, at = 0.0, {}
            for r in [*top, *(r for g, p in zip(body, dealt) if p == part for r in g)]:
                at[r] = y, y + sizes.get(r, 11.25)
                y = at[r][1]
            out += [(part, c["row"], c["column"], c["header"], c["text"], c["x0"], at[c["row"]][0], c["x1"], at[c["row"] + c["row_span"] - 1][1]) for c in made if c["row"] in at]
        return out

    by: dict = {}
    for x in rows:
        by.setdefault(x[0], []).append(x)
    cells = spark.createDataFrame([*rows, (1, None, None, None, None, None, None)], "t int, row int, column int, row_span int, column_span int, text string, header boolean")
    rounded = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for parts, batch, sizes in (("1", "10000", (400.0, 120.0, 240.0)), ("5", "777", (90.0, 500.0, 30.0)), ("2", "1", (333.33, 20.0, 700.0))):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = sorted((rounded(r) for r in redrawn_tables(cells, ["t"], *sizes).collect()), key=repr)
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        want = sorted((rounded((t, *r)) for t, own in by.items() for r in plain(own, *sizes)), key=repr)
        assert got == want, next(((x, y) for x, y in zip(got, want) if x != y), (len(got), len(want)))
    assert redrawn_tables(cells.where("false"), ["t"], 400.0, 120.0, 240.0).collect() == []


def test_many_tables_are_redrawn_in_little_memory(tmp_path):
    """12,000 tables of 80 cells in one task: its Python worker's peak, in a session of its own."""
    import os
    import subprocess
    import sys

    code = """
import resource
from pyspark.sql import SparkSession, functions as F
from sparkfolio.operators.composites import redrawn_tables
conf = {"spark.sql.shuffle.partitions": "1", "spark.ui.enabled": "false", "spark.driver.memory": "3g"}
spark = SparkSession.builder.master("local[1]").config(map=conf).getOrCreate()
n = spark.range(12000 * 40).select(F.floor(F.col("id") / 40).alias("t"), (F.col("id") % 40).cast("int").alias("row"), F.array(F.lit("cell"), F.col("id").cast("string")).alias("a"))
cells = n.select("t", "row", F.posexplode("a").alias("column", "text"), F.lit(1).alias("row_span"), F.lit(1).alias("column_span"), (F.col("row") == 0).alias("header"))
out = redrawn_tables(cells, ["t"], 400.0, 120.0, 240.0)
assert out.where("not header").count() == 12000 * 78
out.write.format("noop").mode("overwrite").save()
def peak(batches):  # the worker is used again
    for b in batches:
        yield b.from_pylist([{"mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024}])
print("MB", max(r.mb for r in spark.range(0, 8, 1, 8).mapInArrow(peak, "mb long").collect()))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": root}).stdout
    assert int(said.split("MB ")[1]) < 500, said


def test_the_source_layer_says_why(spark):
    from sparkfolio.operators.composites import source_layer

    rows = [(1, 0, 0, "head", "page_header", 30.0), (1, 0, 1, "close to it", "text", 36.0), (1, 0, 2, "body", "text", 300.0), (1, 0, 3, "x = 1", "display_formula", 320.0), (1, 0, 4, "c", "table", 340.0), (1, 1, 0, "", "image", 100.0), (1, 1, 1, "12", "page_no", 500.0)]
    blocks = spark.createDataFrame([(*r[:5], (50.0, r[5], 90.0, r[5] + 10)) for r in rows], "doc_id int, page_idx int, n int, text string, type string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    got = {(r.page_idx, r.n): r.disposition for r in source_layer(blocks, 600.0).collect()}
    assert got == {(0, 0): "furniture", (0, 1): "furniture", (0, 2): "source", (0, 3): "formula", (0, 4): "visual_or_table", (1, 0): "visual_page", (1, 1): "visual_page"}
