"""Secret scans with multipart credential linking.

Assignments, access identifiers and long hexadecimal runs are reported
wherever they stand.  A credential often has parts that prove little alone: a
secret of forty mixed characters, or an endpoint.  Such weak candidates are
reported only where a complementary part lies in the same scope, which is the
reach around a part within its paragraph.  Candidates and parts are sorted by
place and joined by searching intervals, so no pairs are listed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.common import col, fresh

#: In the order in which spans of one start are listed; the last two are weak.
KINDS = ("assign", "access", "hex", "secret", "endpoint")
BASE = 3
#: Characters between parts of one credential.
REACH = 200
REDACTED = "[REDACTED]"

_WORDS = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_HINTS = ("passw", "secret", "token", "api")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
# A run of fewer characters contains no longer one, so the least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
_SECRET = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", re.ASCII)
_ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+""", re.ASCII)
_PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")
_SHORTEST_VALUE = 6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the spans that need no partner, sorted."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _SHORTEST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The weak candidates that have a complementary part in their scope."""
    has_access, has_address = any(k == 1 for _, k, _ in base), "://" in text
    if not has_address and not has_access:
        return []
    endpoints = [(m.start(), 4, m.end()) for m in _ENDPOINT.finditer(text)] if has_address else []
    secrets = [(m.start(), 3, m.end()) for m in _SECRET.finditer(text) if _mixed(m[0])]
    if not endpoints and not secrets:
        return []
    breaks = [m.start() for m in _PARAGRAPH.finditer(text)]

    def joined(candidates, *kinds):
        """Candidates with a part in reach; intervals of one kind don't overlap, so its nearest before and after decide."""
        found = []
        sides = [(parts, [p[0] for p in parts], [p[2] for p in parts]) for parts in kinds if parts]
        for start, kind, end in candidates:
            for parts, starts, ends in sides:
                i, j = bisect_right(ends, start), bisect_left(starts, end)
                near = [*parts[i - 1 : i], *parts[j : j + 1]] if i else parts[j : j + 1]
                if any(max(s - end, start - e) <= REACH and bisect_left(breaks, s) == bisect_left(breaks, start) for s, _, e in near):
                    found.append((start, kind, end))
                    break
        return found

    access = [p for p in base if p[1] == 1]
    assign = [p for p in base if p[1] == 0]
    strong = joined(secrets, access, endpoints)
    return sorted({*strong, *joined(endpoints, access, assign, strong)})


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start and then as in KINDS."""
    base = base_spans(text or "")
    return [(KINDS[k], s, e) for s, k, e in sorted([*base, *linked_spans(text or "", base)])]


@F.arrow_udf(_SPANS)
def spans_udf(texts: pa.Array) -> pa.Array:
    out = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py())] for t in texts]
    return pa.array(out, pa.list_(_SPAN))


def redact(text: str | None) -> str | None:
    """The text with each stretch of spans replaced by REDACTED."""
    if text is None:
        return None
    out, at = [], 0
    stretches: list[list[int]] = []
    for _, s, e in find_spans(text):
        if stretches and s < stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], e)
        else:
            stretches.append([s, e])
    for s, e in stretches:
        out += [text[at:s], REDACTED]
        at = e
    return "".join([*out, text[at:]]) if out else text


@F.arrow_udf(T.StringType())
def redact_udf(texts: pa.Array) -> pa.Array:
    return pa.array([redact(t.as_py()) for t in texts], pa.string())


def scan(docs: DataFrame, text_col: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` and a column of spans ``array<struct<kind, start, end>>``, in one pass without a shuffle.

    A null or empty text has no spans.  Rows are independent, so repeated
    rows, null ids and empty tables need no care; the new column takes another
    name if ``docs`` has it already.
    """
    (name,) = fresh(docs, name)
    return docs.select("*", spans_udf(col(text_col)).alias(name))


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with spans replaced in the text, and the length column, if there is one, after it."""
    if length_col not in docs.columns:
        return docs.withColumn(text_col, redact_udf(col(text_col)))
    (name,) = fresh(docs, "redacted")
    both = docs.select("*", redact_udf(col(text_col)).alias(name))
    length = F.when(col(text_col).eqNullSafe(F.col(name)), col(length_col)).otherwise(F.length(name).cast("long"))
    kind = dict(docs.dtypes)[length_col]
    new = {text_col: F.col(name).alias(text_col), length_col: length.cast(kind).alias(length_col)}
    return both.select(*[new.get(c, col(c)) for c in docs.columns])


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and ``n_linked`` per document."""
    found = scan(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")))
    spans = F.col("spans")
    n = lambda *kinds: F.size(F.filter(spans, lambda s: s["kind"].isin(*kinds))).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:BASE]))
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), n(*KINDS[BASE:]).alias("n_linked"),
    )
