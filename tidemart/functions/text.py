"""Word match and highlighting.

A word is an unbroken run of letters and digits of any script, compared in lower
case. Whether a text holds a word is asked with a pattern, not by building an array of
all its words: one scan of the text, no allocation, and a plain substring test in
front of it turns most rows away.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_AFTER_WORD = r"(?<![\p{L}\p{N}])"
_NOT_BEFORE_WORD = r"(?![\p{L}\p{N}])"


def query_words(query: str) -> list[str]:
    """Distinct lower-case words of a search phrase, in order."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def has_word(text: Column, word: str) -> Column:
    lowered = F.lower(text)
    return lowered.contains(word) & lowered.rlike(_NOT_AFTER_WORD + re.escape(word) + _NOT_BEFORE_WORD)


def match_all_terms(text: Column, query: str) -> Column:
    """True where every word of ``query`` occurs. A query without words matches nothing."""
    tests = [has_word(text, w) for w in query_words(query)]
    return reduce(Column.__and__, tests) if tests else F.lit(False)


def match_any_term(text: Column, query: str) -> Column:
    """True where at least one word of ``query`` occurs."""
    tests = [has_word(text, w) for w in query_words(query)]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def highlight(text: Column, query: str, before: str = "<em>", after: str = "</em>") -> Column:
    """``text`` with each occurrence of a query word between ``before`` and ``after``."""
    words = query_words(query)
    if not words:
        return text
    pattern = f"(?iu){_NOT_AFTER_WORD}({'|'.join(map(re.escape, words))}){_NOT_BEFORE_WORD}"
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{before}$1{after}"))
