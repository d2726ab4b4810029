"""Regular expressions that mean the same in the JVM and in RE2.

Neither \\b nor \\w agree between engines outside ASCII, so a word's edge is written out, and case is folded by lower().
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"


def quote(term: str) -> str:
    """A literal term as a pattern."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def whole(pattern: str) -> str:
    """The pattern as whole words."""
    return f"(?:^|{NON_WORD})(?:{pattern})(?:$|{NON_WORD})"


def any_of(words) -> str:
    """One of these words, as a whole."""
    return whole("|".join(map(quote, words)))


def has_word(text: Column, words) -> Column:
    """Whether lower-cased text has one of these words."""
    return F.lower(text).rlike(any_of(words))


def quote_column(term: Column) -> Column:
    """A column's literal value as a pattern."""
    return F.regexp_replace(term, r"([^\p{L}\p{N}_\s])", r"\\$1")


def has_term(text: Column, term: Column) -> Column:
    """Whether text has a column's term as a whole, in either case."""
    return F.rlike(F.lower(text), F.concat(F.lit(f"(?:^|{NON_WORD})(?:"), quote_column(F.lower(term)), F.lit(f")(?:$|{NON_WORD})")))


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(text, F.lit(pattern), group)
