"""Texts of a model without its loops: lines that leak its input, repeated lines, sentences and word groups.

clean() works on whole texts in Arrow batches; a null text stays null, an empty one empty.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import ship_package

# Words that only a model's training data says.
LEAKS = ("model_input", "wikisource", "wikipedia", "wikiquote")
LEAST_WORDS = 3
#: Groups of as many words are looked up, shorter ones compared.
LONG = 12

_LEAK = re.compile(rf"(?i)\b(?:{'|'.join(LEAKS)})\b")
_GIVEN = re.compile(r"(?i)\bmodel_input\s*=\s*([^\n-]*)")
_STOP = re.compile(r"[.!?]+(?:\s+|$)")
_RUN = re.compile(r"\w+(?:\s+\w+)+")
_WORD = re.compile(r"\w+")


def without_leaks(lines: list[str], text: str) -> list[str]:
    """Lines that neither name the model's input or a source nor repeat what was given as input."""
    given = {g.strip().lower() for g in _GIVEN.findall(text)} - {""}
    return ["" if not t.strip() else t for t in lines if not _LEAK.search(t) and t.strip().lower() not in given]


def without_runs(lines: list[str]) -> list[str]:
    """Of a line that comes twice in a row one stays, of three times or more none; blank lines stay."""
    out: list[str] = []
    at = 0
    while at < len(lines):
        low, end = lines[at].strip().lower(), at + 1
        while low and end < len(lines) and lines[end].strip().lower() == low:
            end += 1
        if not low or end - at < 3:
            out.append(lines[at] if low else "")
        at = end
    return out


def without_echoes(paragraph: str) -> str:
    """A paragraph in which no sentence says what the one before said."""
    out: list[str] = []
    before, at = None, 0
    for stop in [*_STOP.finditer(paragraph), None]:
        end = stop.end() if stop else len(paragraph)
        said = paragraph[at : stop.start() if stop else end].strip().lower()
        if not said or said != before:
            out.append(paragraph[at:end])
            before = said or before
        at = end
    return "".join(out)


def _longest(low: str, spans: list[tuple[int, int]], places: dict[str, list[int]], k: int, least: int) -> int:
    """Words of the longest group at word k that follows upon itself, or 0."""
    start, half = spans[k][0], (len(spans) - k) // 2

    def twice(n: int) -> bool:
        size, other = spans[k + n - 1][1] - start, spans[k + n][0]
        first = min(size, 64)  # most places differ soon
        return spans[k + 2 * n - 1][1] - other == size and low.startswith(low[start : start + first], other) and low[start : start + size] == low[other : other + size]

    if half >= LONG:
        found = places[low[start : spans[k + LONG - 1][1]]]
        for j in reversed(found[bisect_left(found, k + LONG) : bisect_right(found, k + half)]):
            if twice(j - k):
                return j - k
    return next((n for n in range(min(half, LONG - 1), least - 1, -1) if twice(n)), 0)


def without_repeats(text: str, least: int = LEAST_WORDS) -> str:
    """Groups of three words or more that follow upon themselves stay once, the longest group at the first place first.

    Words of a group stand between blanks alone. Groups under LONG words are compared at each place, longer ones where their
    first LONG words recur, so a long text takes a time in proportion to its length unless so many words recur very often.
    """
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out: list[str] = []
    done = 0
    for run in _RUN.finditer(text):
        spans = [m.span() for m in _WORD.finditer(text, run.start(), run.end())]
        if len(spans) < 2 * least:
            continue
        places: dict[str, list[int]] = {}
        for k in range(len(spans) - LONG + 1):
            places.setdefault(low[spans[k][0] : spans[k + LONG - 1][1]], []).append(k)
        k = 0
        while k <= len(spans) - 2 * least:
            found = _longest(low, spans, places, k, least)
            if not found:
                k += 1
                continue
            group, end = low[spans[k][0] : spans[k + found - 1][1]], k + found
            while end + found <= len(spans) and low[spans[end][0] : spans[end + found - 1][1]] == group:
                end += found
            out.append(text[done : spans[k + found - 1][1]])
            done = spans[end - 1][1]
            k = end
    return "".join([*out, text[done:]])


def clean_text(text: str) -> str:
    """The text after all five steps; the last leaves one blank line at most between lines and none at the ends."""
    lines = without_runs(without_leaks(text.splitlines(), text))
    body = "\n\n".join(without_echoes(p) for p in "\n".join(lines).split("\n\n"))
    return re.sub(r"\n{3,}", "\n\n", without_repeats(body)).strip()


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its text cleaned."""
    ship_package(df.sparkSession)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else clean_text(t))

    return df.withColumn(text, run(F.col(text)))
