"""Queries as users type them."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple


class ParsedQuery(NamedTuple):
    terms: list[str]
    phrases: list[str]
    not_terms: list[str]


def normalize_term(term: str) -> str:
    """Lower-cased, with punctuation (Unicode category P) taken from both ends, whole characters at a time."""
    term = term.lower()
    start, end = 0, len(term)
    while start < end and unicodedata.category(term[start]).startswith("P"):
        start += 1
    while end > start and unicodedata.category(term[end - 1]).startswith("P"):
        end -= 1
    return term[start:end]


def parse_query(text: str) -> ParsedQuery:
    """Blanks, tabs and double quotes part words; a leading hyphen marks a word to leave out. Phrases are not told apart:
    their words are terms. Words that normalise to nothing are dropped."""
    terms, not_terms = [], []
    for word in re.split('[ \t"]+', text):
        negative = len(word) > 1 and word[0] == "-" and word[1] != "-"
        if norm := normalize_term(word[1:] if negative else word):
            (not_terms if negative else terms).append(norm)
    return ParsedQuery(terms, [], not_terms)
