from __future__ import annotations

import random
import zlib

import numpy as np

from sparkfolio.llm import language

SCHEMA = "doc_id bigint, text string, lang string, score int, p string, held_out int"
SYLLABLES = {
    "en": "th ing er and ou the ion wh sh ea".split(), "de": "sch ung ein der ch keit ü ß tz pf".split(),
    "fr": "eau oi é que les è ou ai tion ç".split(), "es": "ción ñ que los ar ado ll ía el ez".split(),
}


def texts(n=160, seed=3):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 80))]
        yield i, " ".join(words).capitalize(), lang, 1, "p", 0


def test_held_out_accuracy_and_contract(spark):
    data = list(texts(600)) + [(9001, None, "en", 1, "p", 0), (9002, "123 -- ½ \n", "de", 1, "p", 0), (9003, "", None, 1, "p", 0), (9004, "the king and the thing", None, 1, "p", 0), (None, "der ein und", "de", 1, "p", 0), (9005, "ƛ", "en", 1, "p", 0)]
    data += [data[0]] * 3
    df = spark.createDataFrame(data, SCHEMA)
    got = language.identify(df.repartition(5)).collect()
    assert len(got) == len(data)
    assert all(r.held_out == (zlib.crc32(("null" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    lang = {r[0]: r[2] for r in data}
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert len(tested) > 80 and sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.97 * len(tested)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[k].lang_pred for k in (9001, 9002, 9003)] == ["und"] * 3 and by_id[9004].lang_pred == "en"
    assert by_id[9005].lang_pred in SYLLABLES
    again = language.identify(df.repartition(2)).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in again) == sorted((str(r.doc_id), r.lang_pred) for r in got)


def test_prediction_ignores_labels_and_ids(spark):
    data = list(texts(300))
    model = language.train(spark.createDataFrame(data, SCHEMA))
    held = [r for r in data if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    changed = [(r[0], r[1], "fr", *r[3:]) if r in held else r for r in data]
    other = language.train(spark.createDataFrame(changed, SCHEMA))
    assert np.array_equal(model.weights, other.weights)


def test_features_do_not_depend_on_blocks(monkeypatch):
    text = next(t for _, t, *_ in texts(1)) * 40
    whole = language.features(text)
    monkeypatch.setattr(language, "BLOCK", 37)
    assert np.array_equal(whole, language.features(text))
    assert abs(np.dot(whole, whole) - 1) < 1e-4 and not language.features("").sum() < 0


def test_machines_separate_and_families_come_first():
    rng = np.random.default_rng(2)
    centre = {"en": (4, 0, 1), "de": (4, 0, -1), "fr": (-4, 1, 0), "xx": (0, -6, 0)}
    langs = [k for k in centre for _ in range(50)]
    x = np.array([centre[k] for k in langs], dtype=np.float32) + rng.normal(0, 0.2, (200, 3)).astype(np.float32)
    model = language.fit(x, langs, language.FAMILIES)
    assert model.families == ["germanic", "romance", "xx"] and model.pairs == [("de", "en")]
    margin = x @ model.weights[:, :-1].T + model.weights[:, -1]
    family = np.array(["germanic"] * 100 + ["romance"] * 50 + ["xx"] * 50)
    assert (np.array(model.families)[margin[:, :3].argmax(axis=1)] == family).all()
    assert ((margin[:100, 3] > 0) == np.array([k == "de" for k in langs[:100]])).all()


def test_one_language_and_nothing_to_learn(spark):
    one = [(i, "the thing and", "en", 1, "p", 0) for i in range(20)]
    assert {r.lang_pred for r in language.identify(spark.createDataFrame(one, SCHEMA)).collect()} == {"en"}
    none = [(i, "the thing and", None, 1, "p", 0) for i in range(20)]
    assert {r.lang_pred for r in language.identify(spark.createDataFrame(none, SCHEMA)).collect()} == {"und"}
    assert language.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeats_wipe_out_no_language(spark):
    """4,000 rows of one id, with one text or with many, against 100 of each other language."""
    rng = random.Random(4)
    made = lambda lang: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(30))
    rest = [(i, made(lang), lang, 1, "p", 0) for i, lang in enumerate(["en", "fr"] * 100)]
    one = made("de")
    for german in ([(7, one, "de", 1, "p", 0)] * 4000, [(7, made("de"), "de", 1, "p", 0) for _ in range(4000)], [(None, one, "de", 1, "p", 0)] * 4000):
        assert any(zlib.crc32(str(r[0] if r[0] is not None else "null").encode()) % 5 for r in german)
        model = language.train(spark.createDataFrame(german + rest, SCHEMA).repartition(3))
        assert sorted(a for m in model.members.values() for a in m) == ["de", "en", "fr"]
        assert [model.predict(made(a))[0] for a in ("en", "fr")] == ["en", "fr"]


def test_more_languages_than_the_sample(spark):
    rows = [(i, f"word{i % 9} text", f"l{i % 9}", 1, "p", 0) for i in range(300)]
    model = language.train(spark.createDataFrame(rows, SCHEMA), sample=4)
    assert model.families == ["l0", "l1", "l2", "l3"]
