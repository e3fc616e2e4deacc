from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkfolio import adapters as A
from sparkfolio.functions import literals as L
from sparkfolio.operators import composites as C
from sparkfolio.settings import Settings


class Flaky:
    """Loses facts of long texts, and fails at first."""

    def __init__(self, most=20, faults=0):
        self.most, self.faults, self.asked = most, faults, []

    def translate(self, text, target, before=None, after=None):
        self.asked.append((text, before))
        if self.faults:
            self.faults -= 1
            raise A.TranslationError("busy", again=True)
        return text.upper() if len(text) <= self.most else "lost"


def test_facts_survive_by_splitting():
    masked, values = L.mask("first A-001 here, then 99.5 % there, last 12 mg end")
    out = A.checked(Flaky(), masked, values, "en")
    assert out.error is None and out.text == "FIRST A-001 HERE, THEN 99.5 % THERE, LAST 12 mg END" and out.attempts > 3
    assert A.checked(Flaky(most=0), "plain", [], "en", depth=4) == A.Outcome("lost", 1, None)
    bad = A.checked(Flaky(most=0), *L.mask("x A-001 y"), "en", depth=4)
    assert bad.text is None and bad.attempts == 3 and bad.error.startswith("missing")
    assert A.checked(Flaky(), "[[0]]", ["A-001"], "en") == A.Outcome("A-001", 0, None)


def test_only_some_errors_are_tried_again_and_the_last_attempt_has_no_context():
    busy = Flaky(faults=2)
    assert A.checked(busy, "word", [], "en", "b", "a").text == "WORD"
    assert A.with_retries(lambda: "x") == ("x", 1)

    class Never:
        def __init__(self):
            self.before = []

        def translate(self, text, target, before=None, after=None):
            self.before.append(before)
            raise A.TranslationError("no")

    never = Never()
    assert A.checked(never, "word [[0]]", ["1"], "en", "b", "a", depth=4) == A.Outcome(None, 3, "no") and never.before == ["b", "b", None]
    with pytest.raises(A.TranslationError):
        A.with_retries(lambda: never.translate("x", "en"))


def test_ledger_with_terms_and_facts(spark):
    units = spark.createDataFrame(
        [(1, 10, "body", 0, 5.0, 0.0, "批号 A-001 合格"), (1, 11, "heading", 0, 5.0, 0.0, "标题"), (1, 12, "cell", 1, 0.0, 0.0, "99.5 %"), (1, 13, "cell", 0, 9.0, 0.0, "english")],
        "doc_id long, unit_id long, kind string, page_idx int, y double, x double, text string",
    )
    terms = spark.createDataFrame([(1, "标题", "Heading", "en", True)], "term_id int, source_term string, required_target string, language string, exact_source boolean")
    translator = A.StaticTranslator({"批号 [[0]] 合格": "Lot [[0]] QA QA passed"})
    got = {r.unit_id: r for r in C.translation_ledger(units, translator, "en", terms).collect()}
    assert [got[k].position for k in (11, 10, 13, 12)] == [0, 1, 2, 3]
    assert got[10].target == "Lot A-001 QA passed" and got[11].target == "Heading" and got[12].target == "99.5 %" and not got[13].translated


def test_recognizer_faults_are_rows(spark):
    import hashlib

    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "path string, content binary")
    known = A.StaticRecognizer({hashlib.sha256(b"x").hexdigest(): "{}"})
    got = {r.path: (r.payload, r.error) for r in A.recognized(files, known, 2).collect()}
    assert got["a"] == ("{}", None) and got["b"][1].startswith("KeyError")
    assert A.CopyEngine().render(b"x", "") == b"x"


def test_settings():
    s = Settings.read({"SPARKFOLIO_JOBS": "3", "SPARKFOLIO_TRANSLATOR_KEY": "k", "SPARKFOLIO_RECOGNIZER_KEY": " ", "SPARKFOLIO_TRANSLATOR_URL": "http://h/v1/chat/completions/"})
    assert (s.jobs, s.recognizer_key, s.translator_url) == (3, "k", "http://h/v1") and s.lacking(True) == []
    assert Settings().lacking(True) == ["translator_key", "recognizer_key"]
    with pytest.raises(ValueError):
        Settings.read({"SPARKFOLIO_JOBS": "99"})


def test_pieces_know_their_neighbours(spark):
    from sparkfolio.operators import units as U

    u = spark.createDataFrame([(1, 1, 0, "a b"), (1, 2, 1, "c")], "doc_id int, unit_id int, position int, text string")
    got = U.fragments(U.with_context(u), F.split("text", " ")).orderBy("unit_id", "fragment").collect()
    assert [(r.piece, r.before, r.after) for r in got] == [("a", None, "b"), ("b", "a", "c"), ("c", "a b", None)]
