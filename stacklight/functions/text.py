"""Tokenizing and stemming as Catalyst expressions: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges that are segmented into single characters and bigrams: ideographs, kana, hangul.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}"
WORD = r"\p{L}\p{Nd}_"
TOKEN_PATTERN = rf"[{CJK}]+|[{WORD}&&[^{CJK}]]+"
#: Those, the two letters whose lower case hangs on their neighbours or is longer (capital sigma, dotted capital I), and unassigned ones,
#: which newer tables may map to letters.
SINGLE = rf"[{CJK}\x{{03A3}}\x{{0130}}\p{{Cn}}]"

#: Suffixes of the stemmer's fourth step, in the order in which they are tried (fixed values).
SUFFIXES = (
    "ement", "ance", "ence", "able", "ible", "ment", "ness", "less", "ful", "ous",
    "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
)

_STEP = r"[aeiouy][^aeiouy]"


def _measure(word: Column) -> Column:
    return F.regexp_count(word, F.lit(_STEP))


def _chop(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _plural(w: Column) -> Column:
    return (
        F.when(~w.endswith("s"), w)
        .when(w.endswith("sses") | w.endswith("ies"), _chop(w, 2))
        .when(w.endswith("ses"), w)
        .when(w.endswith("ss"), w)
        .otherwise(_chop(w, 1))
    )


def _past(w: Column) -> Column:
    # A stem of positive measure before "eed" gets a blank as its last byte: results depend on it.
    return (
        F.when(w.endswith("eed"), F.when(_measure(_chop(w, 3)) > 0, F.concat(_chop(w, 1), F.lit(" "))).otherwise(w))
        .when(w.endswith("ed") & w.rlike("[aeiouy].*ed$"), _chop(w, 2))
        .when(w.endswith("ing") & w.rlike("[aeiouy].*ing$"), _chop(w, 3))
        .otherwise(w)
    )


def _suffix(w: Column) -> Column:
    out = None
    for last in dict.fromkeys(s[-1] for s in SUFFIXES):  # a word is held only against suffixes with its last letter, in their order
        own = None
        for s in dict.fromkeys(s for s in SUFFIXES if s[-1] == last):
            stem = _chop(w, len(s))
            holds = w.endswith(s) & (F.octet_length(w) > len(s)) & (_measure(stem) > 1)
            own = F.when(holds, stem) if own is None else own.when(holds, stem)
        out = F.when(w.endswith(last), own.otherwise(w)) if out is None else out.when(w.endswith(last), own.otherwise(w))
    return out.otherwise(w)


def _final_e(w: Column) -> Column:
    stem = _chop(w, 1)
    cvc = w.rlike("[^aeiouy][aeiouy][bcdfghjklmnpqrstvz0-9_]e$")
    m = _measure(w)
    return F.when(w.endswith("e") & ((m > 1) | ((m == 1) & ~cvc)), stem).otherwise(w)


def stem(word: Column) -> Column:
    """The reduced Porter stem. Each stage is a lambda over a one-element array, which keeps the plan of linear size."""
    out = F.array(word)
    for stage in (_plural, _past, _suffix, _final_e):
        out = F.transform(out, _guarded(stage))
    return out[0]


def _guarded(stage: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda w: F.when(F.octet_length(w) <= 2, w).otherwise(stage(w))


def no_stem(word: Column) -> Column:
    return word


def _segments(token: Column) -> Column:
    n = F.length(token)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.when(i < n, F.array(F.substring(token, i, F.lit(1)), F.substring(token, i, F.lit(2)))).otherwise(F.array(F.substring(token, i, F.lit(1)))),
        )
    )


def tokens(text: Column) -> Column:
    """array<string>: lower-cased words; a CJK run c1..cn gives c1, c1c2, c2, .., cn. A null text has none.

    A text without SINGLE characters is lower-cased as a whole and cut by one expression; only others are taken word by word."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.regexp_extract_all(F.lower(whole), F.lit(f"[{WORD}]+"), F.lit(0))
    runs = F.regexp_extract_all(whole, F.lit(f"({TOKEN_PATTERN})"), F.lit(1))
    mixed = F.flatten(F.transform(runs, lambda t: F.when(t.rlike(f"^[{CJK}]"), _segments(t)).otherwise(F.array(F.lower(t)))))
    return F.when((F.octet_length(whole) == F.length(whole)) | ~whole.rlike(SINGLE), plain).otherwise(mixed)


Stemmer = Callable[[Column], Column]
