"""Language identification by family first, then one against one within it.

A text is the vector of its byte n-grams, hashed and scaled to length one.
Linear support vector machines tell the families apart; within the family a
machine for each pair of languages votes.  All are fitted on a bounded sample
of labelled documents, whose vectors have a fixed size however long the texts.
"""

from __future__ import annotations

import functools
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.common import col

#: Families of the languages that are told apart; a language without one is its own family.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic",
}
UNKNOWN = "und"
#: Documents that the models are fitted on, over all languages together, and how many of a language at most.
SAMPLE, SAMPLE_PER_LANG = 1600, 400
#: Different rows of a language that are looked at for its share of the sample: so many times the share, and so many more.
SPARE, SPARE_LEAST = 2, 200
#: Remainders of the id's checksum by this; rows with remainder 0 are never learned from.
FOLDS = 5
BUCKET_BITS = 12
GRAMS = (1, 2, 3)
#: Bytes that are hashed at a time.
BLOCK = 1 << 20
PENALTY, STEPS = 1e-4, 400

_LETTER = re.compile(r"[^\W\d_]")
# Letters keep their bytes, lower case; all other ASCII is a gap.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether a character of category L is in the text."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text, each by its logarithm, scaled to length one."""
    folded = b" " + b" ".join(text.encode(errors="surrogatepass").translate(_FOLD).split()) + b" "
    size = 1 << BUCKET_BITS
    counts = np.zeros(size * len(GRAMS), dtype=np.int64)
    overlap = max(GRAMS) - 1
    for at in range(0, len(folded), BLOCK):
        raw = np.frombuffer(folded[at : at + BLOCK + overlap], dtype=np.uint8).astype(np.uint32)
        h = np.zeros(len(raw), dtype=np.uint32)
        for k, n in enumerate(GRAMS):
            m = max(0, len(raw) - n + 1)
            h = h[:m] * np.uint32(0x9E3779B1) + raw[n - 1 : n - 1 + m] + np.uint32(1)
            own = h[: min(m, BLOCK)]
            mixed = (own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            counts[k * size : (k + 1) * size] += np.bincount(mixed >> np.uint32(32 - BUCKET_BITS), minlength=size)
    x = np.log1p(counts).astype(np.float32)
    norm = float(np.sqrt(np.dot(x, x)))
    return x / np.float32(norm) if norm else x


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and a bias (last) of a linear machine with squared hinge loss; ``y`` is 1 or -1.

    Accelerated full-batch descent from zero: the result depends on the data
    alone.  Classes count alike, whatever their sizes.
    """
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)
    bound = float((c * (x * x).sum(axis=1)).sum()) * 2 + PENALTY
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ v))
        step = v - (PENALTY * v - 2 * ((c * y * slack) @ x)) / np.float32(bound)
        v = step + np.float32(k / (k + 3)) * (step - w)
        w = step
    return w


@dataclass
class Model:
    """Machines by row of ``weights``: one a family against the rest, then one a pair of languages of a family."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and a score from 0 to 1; UNKNOWN and 0 for a text that is null or has no letter."""
        if not self.families or not text or not has_letter(text):
            return UNKNOWN, 0.0
        margin = self.weights[:, :-1] @ features(text) + self.weights[:, -1]
        best = int(np.argmax(margin[: len(self.families)]))
        family = self.families[best]
        rest = np.delete(margin[: len(self.families)], best)
        sure = _logistic(margin[best] - rest.max()) if len(rest) else 1.0
        votes = {lang: [0, 0.0] for lang in self.members[family]}
        for (a, b), m in zip(self.pairs, margin[len(self.families) :]):
            if a in votes and b in votes:
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += float(m)
                votes[b][1] -= float(m)
        lang = max(votes, key=lambda k: (*votes[k], k))
        against = [m if a == lang else -m for (a, b), m in zip(self.pairs, margin[len(self.families) :]) if lang in (a, b)]
        return lang, float(sure * (_logistic(min(against)) if against else 1.0))


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-4 * np.clip(float(x), -50, 50))))


def fit(x: np.ndarray, langs: list[str], families: dict[str, str]) -> Model:
    """The machines for vectors ``x`` of documents in ``langs``."""
    names = sorted(set(langs))
    family = {a: families.get(a, a) for a in names}
    groups = sorted(set(family.values()))
    members = {g: [a for a in names if family[a] == g] for g in groups}
    lang = np.array(langs)
    of = np.array([family[a] for a in langs])
    rows = [svm(x, np.where(of == g, 1, -1)) if len(groups) > 1 else np.zeros(x.shape[1] + 1, np.float32) for g in groups]
    pairs = [p for g in groups for p in itertools.combinations(members[g], 2)]
    for a, b in pairs:
        at = (lang == a) | (lang == b)
        rows.append(svm(x[at], np.where(lang[at] == a, 1, -1)))
    return Model(groups, members, pairs, np.array(rows, dtype=np.float32).reshape(len(rows), x.shape[1] + 1))


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of the id as text leaves no remainder; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % FOLDS == 0


@F.arrow_udf(T.BinaryType())
def _features_udf(texts: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py()).astype(np.float16).tobytes() for t in texts], pa.binary())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: dict[str, str] | None = None, sample: int = SAMPLE, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on at most ``sample`` documents that have text and language and are not held out.

    Each language gives the same number at most, those with the least hash of
    id and text; rows equal in both count once.  So no language can be crowded
    out by another or by repeats of a row.  With more languages than ``sample``
    those after it in the order of code points are not learned.  The hash's
    bound is set from the number of different rows of each language, so that
    little more than the sample is ever grouped; the chosen documents' vectors,
    24 KB each, come to the driver.
    """
    labelled = docs.where(col(text_col).isNotNull() & col(lang_col).isNotNull() & ~held_out(col(id_col)))
    labelled = labelled.select(col(id_col).alias("id"), col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"))
    labelled = labelled.select("*", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("null")), "text").alias("rank"))
    names = labelled.groupBy("lang").agg(F.approx_count_distinct("rank").alias("n")).orderBy("lang").limit(sample).collect()
    each = max(1, min(per_lang, sample // max(1, len(names))))
    room = SPARE * each + SPARE_LEAST
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, room / max(1, r.n))) for r in names], "lang string, share double")
    low = labelled.join(F.broadcast(share), "lang").where(F.shiftrightunsigned("rank", 11) < F.col("share") * float(1 << 53))
    different = low.groupBy("lang", "rank").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("rank")  # about ``room`` rows of a language
    chosen = different.select("*", F.row_number().over(order).alias("n")).where(F.col("n") <= each)
    got = chosen.select("lang", "n", _features_udf("text").alias("x")).orderBy("lang", "n").collect()
    size = len(GRAMS) << BUCKET_BITS
    x = np.array([np.frombuffer(r.x, dtype=np.float16) for r in got], dtype=np.float32).reshape(len(got), size)
    return fit(x, [r.lang for r in got], FAMILIES if families is None else families)


_PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def prediction(text: Column, model: Model, docs: DataFrame) -> Column:
    """``struct<lang, score>`` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_PREDICTION)
    def predicted(texts: pa.Array) -> pa.Array:
        predict = functools.partial(Model.predict, shared.value)
        out = [predict(t.as_py()) for t in texts]
        lang, score = zip(*out) if out else ((), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return predicted(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per document, learned from ``docs`` itself.

    Predictions read the text and nothing else.  A null text or one without a
    letter is ``und`` with score 0, and so is every text if there is nothing to
    learn from.  Repeated rows are learned from once and get equal answers, and
    an id that many rows have counts once for each of its texts; an empty table
    gives an empty one.
    """
    model = train(docs, id_col, text_col, lang_col)
    found = docs.select(
        col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"),
        prediction(col(text_col).cast("string"), model, docs).alias("p"),
    )
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
