"""Token counts by byte-pair merging over a heap and a linked list.

A count needs no identifiers: it is the number of initial symbols less the
number of merges.  The lowest-rank adjacent pair is popped again and again;
neighbours are found over a doubly linked list, and entries whose pair has
changed since they were pushed are skipped.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.common import col
from sparkfolio.llm.pretokenize import splitter

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Distinct pieces whose counts a Python worker remembers at a time.
REMEMBERED = 400_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class MergeCounter:
    """Counts the tokens of texts under one byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or not pre.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        vocab = spec["model"]["vocab"]
        self.symbols = [vocab[c] for c in byte_alphabet()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.prefix = " " if pre.get("add_prefix_space") else ""
        import public_tokenizers

        self.split = splitter(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Tokens of one piece."""
        n = len(piece)
        if n < 2:
            return n
        merges = self.merges.get
        symbol = [self.symbols[b] for b in piece]
        heap = []
        for i in range(n - 1):
            if found := merges((symbol[i], symbol[i + 1])):
                heap.append((found[0], i))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, count = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            found = merges((symbol[i], symbol[j]))
            if not found or found[0] != rank:
                continue
            symbol[i], symbol[j] = found[1], -1
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if found := merges((symbol[i], symbol[k])):
                    heapq.heappush(heap, (found[0], i))
            h = before[i]
            if h >= 0 and (found := merges((symbol[h], symbol[i]))):
                heapq.heappush(heap, (found[0], h))
        return count

    def _plain(self, text: str) -> int:
        known, total = self.known, 0
        if self.prefix and text and not text.startswith(" "):
            text = self.prefix + text
        for piece in self.split(text):
            n = known.get(piece)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[piece] = self.merged(piece.encode())
            total += n
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; strings of added tokens inside it are one token each."""
        if not text:
            return 0
        if self.added is None:
            return self._plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of each text, as a column."""

    @F.arrow_udf(T.LongType())
    def counted(texts: pa.Array) -> pa.Array:
        count = counter(path).count
        return pa.array([count(t.as_py()) for t in texts], pa.int64())

    return counted(text)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per document, in one pass without a shuffle.

    A null text counts as an empty one: no bytes, no tokens, not over the
    limit.  Repeated rows, null ids and further columns pass or are ignored; an
    empty table gives an empty one.  Pieces of any length take
    ``n log n`` steps, and what a worker remembers is bounded by REMEMBERED.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    counted = docs.select(col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens"))
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
