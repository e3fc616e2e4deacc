"""Splitting text into the pieces that byte-level BPE merges separately.

The pattern of the public rank files needs ``\\p{L}``, ``\\p{N}`` and Unicode
white space.  The ``regex`` library has them but is several times slower than
the built-in engine, so the same alternatives are compiled there with explicit
classes: those of ASCII for ASCII texts, else all that ``regex`` knows.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Callable

import regex


def _runs(kind: str) -> str:
    """The members of a Unicode class as the inside of a character class."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    hex8 = lambda c: f"\\U{ord(c):08x}"
    return "".join(f"{hex8(m[0])}-{hex8(m[-1])}" for m in regex.findall(f"{kind}+", every))


def _compiled(letter: str, number: str, space: str) -> Callable[[str], list[str]]:
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    ).findall


@functools.cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function from a text to its pieces in order, which together are the text.

    ``pattern`` is the tokenizer's own; any but the one that is known here is
    left to the ``regex`` library.
    """
    known = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    if pattern != known:
        return regex.compile(pattern).findall
    ascii_only = _compiled("A-Za-z", "0-9", r"\t-\r ")
    latin_1 = _compiled("A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0")
    whole: list[Callable[[str], list[str]]] = []

    def split(text: str) -> list[str]:
        if text.isascii():
            return ascii_only(text)
        try:
            text.encode("latin-1")
            return latin_1(text)
        except UnicodeEncodeError:
            if not whole:
                whole.append(_compiled(_runs(r"\p{L}"), _runs(r"\p{N}"), _runs(r"\s")))
            return whole[0](text)

    return split
