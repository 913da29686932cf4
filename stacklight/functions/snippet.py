"""Highlighted excerpts of the few documents that a page of results shows."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _spots(text: str, term: str) -> Iterator[int]:
    at = text.find(term)
    while at >= 0:
        yield at
        at = text.find(term, at + len(term))


def _fold(text: str) -> str:
    """Lower case without changes of length, so that places stay comparable."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def make_snippet(content: str | None, terms: list[str], width: int = 200) -> str:
    """The leftmost window of `width` characters in which most matches begin, each term's matches between `**`.

    Terms match as substrings, case aside; they are marked one after the other, so a term may be marked within a mark. Dots
    stand for text left out. Without terms or matches: the beginning. Empty terms are ignored.
    """
    content, terms = content or "", [_fold(t) for t in terms if t]
    width = width if width > 0 else 200
    folded = _fold(content)
    starts = sorted(p for t in terms for p in _spots(folded, t))
    if not starts:
        return content[:width] + "..." if len(content) > width else content
    # a best window need only begin at 0 or just so far left of a match that this match is its last
    best, most = 0, 0
    for begin in sorted({0, *(max(0, p - width + 1) for p in starts)}):
        n = bisect.bisect_left(starts, begin + width) - bisect.bisect_left(starts, begin)
        if n > most:
            best, most = begin, n
    out = content[best : best + width]
    for t in terms:
        parts, at = [], 0
        for p in _spots(_fold(out), t):
            parts += [out[at:p], "**", out[p : p + len(t)], "**"]
            at = p + len(t)
        out = "".join(parts) + out[at:]
    return ("..." if best else "") + out + ("..." if best + width < len(content) else "")


def snippet(content: Column, terms: list[str], width: int = 200) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: make_snippet(t, terms, width))

    return run(content)
