"""Masking and exact restoration of facts: dates, quantities, codes, acronyms, formulae, numbers.

A literal becomes a slot ``[[n]]``.  Restoration goes by the slot's number
alone, tolerates the ways in which brackets get changed, and says what is
wrong if a slot is missing, doubled or left over; ``restore(mask(x)) == x``.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from sparkfolio import fixed
from sparkfolio.thresholds import T

_LITERAL = re.compile(
    rf"""
    (?<![A-Za-z0-9])\d{{1,4}}[-/.]\d{{1,2}}[-/.]\d{{1,4}}(?![A-Za-z0-9])      # a date
  | (?:[<>≤≥=±]\s*)?\d[\d,]*(?:\.\d+)?\s?(?:%|‰|°C|℃|(?:mg|kg|g|ml|l|mm|cm|m|km|h|min|s|V|A|W|Hz)(?![A-Za-z]))   # a quantity
  | (?<![A-Za-z0-9])[A-Za-z]*\d[A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)+(?![A-Za-z0-9])  # a code with a digit first
  | (?<![A-Za-z0-9])[A-Za-z]+[-_/][A-Za-z]*\d[A-Za-z0-9]*(?![A-Za-z0-9])          # a code with letters first
  | (?<![A-Za-z0-9])[A-Z]{{2,8}}(?![A-Za-z0-9])                          # an acronym
  | (?<![A-Za-z0-9])[A-Za-z]\s?=\s?[A-Za-z0-9+\-*/^.]+                 # a formula
  | {fixed.FORMULA_IN_TEXT}                                            # a chemical formula
  | {fixed.CAPITAL_AFTER_HAN}                                          # a single capital after a Chinese character
  | \d[\d,]*(?:\.\d+)?                                                 # a number
    """,
    re.VERBOSE,
)
#: A plain number without surroundings, for engines that know no lookaround.
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
_SLOT = re.compile(r"\[\[\d+\]\]")
_CLAUSE = re.compile(rf"[^{fixed.CLAUSE_MARKS}]*[{fixed.CLAUSE_MARKS}]+\s*|[^{fixed.CLAUSE_MARKS}]+$")
# Full-width, lenticular, spaced and single brackets; what follows a bar inside is ignored.
_LOOSE = re.compile(r"(?:[\[［【]\s*){1,2}(\d+)\s*(?:\|[^\]］】]*)?(?:\s*[\]］】]){1,2}")


def literals(text: str | None, known: frozenset[str] | None = None) -> list[str]:
    """The literals in order; with ``known`` all-caps words stay text unless they are among them."""
    found = [m[0] for m in _LITERAL.finditer(text or "")]
    return [x for x in found if known is None or not re.fullmatch("[A-Z]{2,}", x) or x in known]


def mask(text: str | None, known: frozenset[str] | None = None) -> tuple[str, list[str]]:
    """The text with slots, and the literals by number; brackets that look like slots are literals too."""
    out: list[str] = []

    def slot(value: str) -> str:
        out.append(value)
        return f"[[{len(out) - 1}]]"

    def literal(m: re.Match) -> str:
        plain = known is not None and re.fullmatch("[A-Z]{2,}", m[0]) and m[0] not in known
        return m[0] if plain else slot(m[0])

    pieces, at = [], 0
    for m in _LOOSE.finditer(text or ""):
        pieces += [_LITERAL.sub(literal, (text or "")[at : m.start()]), slot(m[0])]
        at = m.end()
    return "".join([*pieces, _LITERAL.sub(literal, (text or "")[at:])]), out


def expose(masked: str, values: list[str]) -> str:
    """Slots that show their value, ``[[n|value]]``."""
    return _SLOT.sub(lambda m: f"[[{m[0][2:-2]}|{values[int(m[0][2:-2])]}]]" if int(m[0][2:-2]) < len(values) else m[0], masked)


def restore(masked: str | None, values: list[str]) -> tuple[str | None, str | None]:
    """``(text, error)``: the text with its literals, or what stands against it.

    A slot that is missing is made good if its value stands in the text as
    often as literals of that value are missing.
    """
    said, pieces, seen, unknown, at = masked or "", [], Counter(), False, 0
    for m in _LOOSE.finditer(said):
        n = int(m[1]) if len(m[1]) < 10 else len(values)
        if n < len(values):
            seen[n] += 1
            pieces += [said[at : m.start()], values[n]]
            at = m.end()
        else:
            unknown = True
    pieces.append(said[at:])
    doubled = min((n for n, times in seen.items() if times > 1), default=None)
    if doubled is not None:
        return None, f"doubled:{doubled}"
    if unknown:
        return None, "unknown slot"
    # Text between slots; a value does not reach over the place of one.
    between = "\n".join(pieces[::2])
    lacking = Counter(values[n] for n in range(len(values)) if n not in seen)
    for n in range(len(values)):
        if n not in seen and (times := lacking.pop(values[n], None)) is not None:
            if len(re.findall(rf"(?<![A-Za-z0-9]){re.escape(values[n])}(?![A-Za-z0-9])", between)) != times:
                return None, f"missing:{n}"
    return "".join(pieces), None


def slots_in(fragment: str, values: list[str]) -> list[int]:
    """Numbers of the slots in a fragment, each as a whole."""
    return [int(m[0][2:-2]) for m in _SLOT.finditer(fragment) if int(m[0][2:-2]) < len(values)]


def clauses(text: str) -> list[str]:
    """Pieces that end at a clause mark, which together are the text."""
    return _CLAUSE.findall(text) if text else []


def packed(text: str, slots: int = T.chunk_slots, chars: int = T.chunk_chars) -> list[str]:
    """Chunks of whole clauses within the bounds; a clause that is beyond them is cut between slots and words."""
    out: list[str] = []
    held, n = "", 0
    for clause in clauses(text):
        for piece in _within(clause, slots, chars):
            k = len(_SLOT.findall(piece))
            if held and (n + k > slots or len(held) + len(piece) > chars):
                out.append(held)
                held, n = "", 0
            held, n = held + piece, n + k
    return [*out, held] if held else out


def _within(clause: str, slots: int, chars: int) -> list[str]:
    """A clause cut where it must be: never within a slot, between words where that is possible."""
    if len(clause) <= chars and len(_SLOT.findall(clause)) <= slots:
        return [clause]
    out, held, n = [], "", 0
    for unit in re.findall(r"\[\[\d+\]\]|\s+|[^\s\[]+|\[", clause):
        is_slot = bool(_SLOT.fullmatch(unit))
        for part in [unit] if is_slot else [unit[k : k + chars] for k in range(0, len(unit), chars)]:
            if held and (len(held) + len(part) > chars or n + is_slot > slots):
                out.append(held)
                held, n = "", 0
            held, n = held + part, n + is_slot
    return [*out, held] if held else out


def similarity(a: str | None, b: str | None, most: int | None = None) -> float | None:
    """Ratio of matching characters of two texts, or of their first ``most`` characters."""
    if a is None or b is None:
        return None
    return 1.0 if a[:most] == b[:most] else difflib.SequenceMatcher(None, a[:most], b[:most], autojunk=False).ratio()


def matched_length(a: str | None, b: str | None, most: int | None = None) -> int:
    """Number of matching characters of two texts, or of their first ``most`` characters."""
    a, b = (a or "")[:most], (b or "")[:most]
    if a == b:
        return len(a)
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def similar(a: str | None, b: str | None, least: float) -> bool:
    """Whether the ratio of two whole texts is ``least`` or more; its upper bounds come first."""
    if not a or not b:
        return False
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return a == b or (m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least)


_MASKED = ST.StructType([ST.StructField("masked", ST.StringType()), ST.StructField("literals", ST.ArrayType(ST.StringType()))])
_RESTORED = ST.StructType([ST.StructField("text", ST.StringType()), ST.StructField("error", ST.StringType())])


@F.arrow_udf(_MASKED)
def mask_udf(texts: pa.Array) -> pa.Array:
    rows = [mask(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["masked", "literals"])


@F.arrow_udf(_RESTORED)
def restore_udf(masked: pa.Array, values: pa.Array) -> pa.Array:
    rows = [restore(m, v or []) for m, v in zip(masked.to_pylist(), values.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["text", "error"])


@F.arrow_udf(ST.ArrayType(ST.StringType()))
def packed_udf(texts: pa.Array) -> pa.Array:
    return pa.array([packed(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(ST.DoubleType())
def similarity_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similarity(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


@F.arrow_udf(ST.BooleanType())
def similar_udf(a: pa.Array, b: pa.Array, least: pa.Array) -> pa.Array:
    return pa.array([similar(x, y, z) for x, y, z in zip(a.to_pylist(), b.to_pylist(), least.to_pylist())], pa.bool_())


@F.arrow_udf(ST.IntegerType())
def matched_length_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([matched_length(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def similarity_ratio(a: Column, b: Column) -> Column:
    """As ``similarity``; equal texts never reach Python."""
    return F.when(a == b, 1.0).otherwise(similarity_udf(a, b))


def numbers(text: Column) -> Column:
    """All plain numbers in order."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
