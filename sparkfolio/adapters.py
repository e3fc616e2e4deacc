"""Interfaces to what is outside the engine: translation, recognition, page rendering.

Nothing here reaches a network.  An adapter is an object that is shipped to the
executors; each has a double that works from data.  The retry ladder around a
translator is part of the engine, since it decides what a unit's text is.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkfolio.functions import literals as L
from sparkfolio.thresholds import T


class TranslationError(Exception):
    """What a translator raises when it gives no text; ``again`` says whether to ask once more."""

    def __init__(self, message: str, again: bool = False) -> None:
        super().__init__(message)
        self.again = again


class Translator(Protocol):
    def translate(self, text: str, target: str, before: str | None = None, after: str | None = None) -> str: ...


class Recognizer(Protocol):
    def recognize(self, content: bytes) -> str:
        """A layout payload as JSON."""
        ...


class PageEngine(Protocol):
    def render(self, source: bytes, placements: str) -> bytes: ...


@dataclass(frozen=True)
class StaticTranslator:
    """Translates by a dictionary; other texts get a prefix, slots and all."""

    known: dict[str, str] = field(default_factory=dict)
    prefix: str = "~"

    def translate(self, text: str, target: str, before: str | None = None, after: str | None = None) -> str:
        return self.known.get(text, f"{self.prefix}{text}")


@dataclass(frozen=True)
class RefusingTranslator(StaticTranslator):
    """Fails on texts that hold ``mark``, each time it is asked."""

    mark: str = ""

    def __init__(self, mark: str, again: bool = False) -> None:
        super().__init__()
        object.__setattr__(self, "mark", mark)
        object.__setattr__(self, "again", again)

    def translate(self, text: str, target: str, before: str | None = None, after: str | None = None) -> str:
        if self.mark in text:
            raise TranslationError("refused", self.again)
        return super().translate(text, target, before, after)


@dataclass(frozen=True)
class StaticRecognizer:
    """Recognises what it has been told, by the SHA-256 of the content."""

    known: dict[str, str]

    def recognize(self, content: bytes) -> str:
        import hashlib

        return self.known[hashlib.sha256(content).hexdigest()]


@dataclass(frozen=True)
class CopyEngine:
    """Renders a document as itself."""

    def render(self, source: bytes, placements: str) -> bytes:
        return source


@dataclass(frozen=True)
class Outcome:
    text: str | None
    attempts: int
    error: str | None


def with_retries(call: Callable[[], str], attempts: int = 3, wait: Callable[[int], None] = lambda k: time.sleep(2**k)) -> tuple[str, int]:
    """The result of a call and how often it was made; only errors that allow it are tried again."""
    for k in range(attempts):
        try:
            return call(), k + 1
        except TranslationError as e:
            if not e.again or k + 1 == attempts:
                raise
            wait(k)
    raise TranslationError("no attempt was made")


def checked(translator: Translator, masked: str, values: list[str], target: str, before: str | None = None, after: str | None = None, depth: int = 0, wait: Callable[[int], None] = lambda k: None) -> Outcome:
    """A masked unit's translation with its facts restored, or why there is none.

    With facts three attempts are made, else two; the last goes without
    context.  If the facts do not survive, the unit is cut in two between
    slots, four times at most, and a lone slot stays its value.
    """
    if not masked.strip():
        return Outcome(masked, 0, None)
    only = L.slots_in(masked, values)
    if len(only) == 1 and masked.strip() == f"[[{only[0]}]]":
        return Outcome(masked.replace(f"[[{only[0]}]]", values[only[0]]), 0, None)
    local = [values[k] for k in only]
    asked = masked
    for i, k in enumerate(only):
        asked = asked.replace(f"[[{k}]]", f"\x00{i}\x00")
    for i in range(len(only)):
        asked = asked.replace(f"\x00{i}\x00", f"[[{i}]]")
    made, error = 0, "no attempt"
    most = 3 if only else 2
    for k in range(most):
        last = k + 1 == most
        try:
            said, n = with_retries(lambda: translator.translate(asked, target, None if last else before, None if last else after), wait=wait)
            made += n
        except TranslationError as e:
            made, error = made + 1, str(e)
            continue
        text, error = L.restore(said, local)
        if text is not None and text.strip():
            return Outcome(text, made, None)
        error = error or "no text"
    if depth < 4 and (halves := split_between_slots(masked)):
        parts = [checked(translator, h, values, target, before, after, depth + 1, wait) for h in halves]
        made += sum(p.attempts for p in parts)
        if all(p.error is None for p in parts):
            return Outcome("".join(p.text or "" for p in parts), made, None)
        error = next(p.error for p in parts if p.error)
    return Outcome(None, made, error)


def split_between_slots(masked: str) -> tuple[str, str] | None:
    """Two halves of a unit, cut at the clause or slot boundary that is closest to the middle."""
    pieces = L.packed(masked, slots=1, chars=max(1, min(T.chunk_chars, len(masked) // 2)))
    if len(pieces) < 2:
        return None
    stops, at = [], 0
    for p in pieces[:-1]:
        at += len(p)
        stops.append(at)
    cut = min(stops, key=lambda s: (abs(2 * s - len(masked)), s))
    return masked[:cut], masked[cut:]


def translated(units: DataFrame, translator: Translator, target: str) -> DataFrame:
    """``units(unit_id, masked, literals, previous, next)`` with ``target, attempts, error``; a failed unit does not stop the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for unit, masked, values, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                o = checked(translator, masked or "", values or [], target, before, after)
                rows.append((unit, o.text, o.attempts, o.error))
            types = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)], ["unit_id", "target", "attempts", "error"])

    kind = dict(units.dtypes)["unit_id"]
    return units.select("unit_id", "masked", "literals", "previous", "next").mapInArrow(run, f"unit_id {kind}, target string, attempts int, error string")


def recognized(files: DataFrame, recognizer: Recognizer, partitions: int) -> DataFrame:
    """Layout payloads of ``files(path, content)``; ``partitions`` bounds how many are asked for at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str | None, str | None]] = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    out.append((path, recognizer.recognize(content), None))
                except Exception as e:  # one file's fault is a row, not the end of the job
                    out.append((path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 3, ["path", "payload", "error"])

    return files.select("path", "content").repartition(partitions).mapInArrow(run, "path string, payload string, error string")
