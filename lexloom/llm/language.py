"""Language identification by rank-order profiles.

A text's n-grams (1 to 3 letters, words set off by a boundary mark) are ranked by frequency, ties by code. A language's
profile is the same ranking over a bounded sample of its texts. The distance of a text to a profile is the sum,
over the text's TOP most frequent n-grams, of how far each is out of place; one that the profile lacks costs TOP.
The nearest profile wins; ties go to the smallest name. The score is how far the nearest is below the worst distance,
relative to the second nearest: 1 - best / second, or 1 - best / worst where there is one profile.

Fitting takes at most `sample` rows, chosen by a hash of id and text, of up to `max_chars` characters each, and learns
the `most` most frequent languages; so a column of dirty values can neither fill the driver nor the plan. Prediction
reads whole texts. Cases: null texts and texts without a letter are `und` with score 0; rows without a language or
id are not learned from; repeated rows count each time and get equal answers; with no profile at all (an empty
table) everything is `und`; docs' own columns named lang_pred or score are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import ship_package

TOP = 400
SAMPLE = 4000
MOST = 200
MAX_CHARS = 20_000
UNKNOWN = "und"
_EDGE = 0x5F
_BLOCK = 1 << 18
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    if not _letters:
        table = np.zeros(0x110000, dtype=bool)
        table[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = True
        _letters.append(table)
    return _letters[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's n-grams, codes ascending. A code is up to three code points of 21 bits."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = 0
    while at < len(text):
        end = at + _BLOCK
        while end < len(text) and text[end - 1].isalpha():  # a block ends behind a word
            end += 1
        grams = _block_grams(text[at:end])
        c, n = np.unique(grams, return_counts=True)
        if codes.size:
            every, place = np.unique(np.concatenate([codes, c]), return_inverse=True)
            codes, counts = every, np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
        else:
            codes, counts = c, n
        at = end
    return codes, counts


def _block_grams(text: str) -> np.ndarray:
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = _letter_table()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    x, l = np.where(letter, points, _EDGE)[keep], letter[keep]
    if not l.any():
        return np.zeros(0, np.int64)
    two = (x[:-1] << 21 | x[1:])[l[:-1] | l[1:]]
    three = (x[:-2] << 42 | x[1:-1] << 21 | x[2:])[l[1:-1]]
    return np.concatenate([x[l], two, three])


def ranked(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent codes, most frequent first."""
    if codes.size > top:
        least = np.partition(counts, counts.size - top)[counts.size - top]
        use = counts >= least
        codes, counts = codes[use], counts[use]
    return codes[np.lexsort((codes, -counts))][:top]


class Profiles:
    """The languages' rankings, side by side."""

    def __init__(self, ranks: dict[str, np.ndarray], top: int = TOP):
        self.top, self.names = top, sorted(ranks)
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *ranks.values()]))
        self.ranks = np.full((self.codes.size + 1, len(self.names)), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, ranks[name]), k] = np.arange(ranks[name].size)

    def distances(self, text: str) -> np.ndarray | None:
        """To each language; None if the text has no letter."""
        own = ranked(*gram_counts(text), self.top)
        if not own.size:
            return None
        at = np.minimum(np.searchsorted(self.codes, own), self.codes.size - 1)
        at = np.where(self.codes[at] == own, at, self.codes.size)
        ranks = self.ranks[at]
        return np.where(ranks < 0, self.top, np.abs(ranks - np.arange(own.size)[:, None])).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score."""
        d = self.distances(text) if text and self.names else None
        if d is None:
            return UNKNOWN, 0.0
        order = np.argsort(d, kind="stable")
        worst = float(d[order[1]]) if d.size > 1 else float(self.top) * self.top
        return self.names[order[0]], 1 - float(d[order[0]]) / worst if worst else 0.0


def fit(rows: list[tuple[str, str]], top: int = TOP) -> Profiles:
    """Profiles of (language, text) rows."""
    held: dict[str, list] = {}
    for lang, text in rows:
        held.setdefault(lang, []).append(text)
    ranks = {}
    for lang, texts in held.items():
        codes, counts = gram_counts("\n".join(texts))
        if codes.size:
            ranks[lang] = ranked(codes, counts, top)
    return Profiles(ranks, top)


def train(docs: DataFrame, usable: F.Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, max_chars: int = MAX_CHARS, top: int = TOP, most: int = MOST) -> Profiles:
    """Profiles from at most `sample` of the rows that meet `usable`; each of the `most` most frequent languages has an equal share.

    Rows are told apart by a hash of id and text, so a hot id or text is not taken as a whole.
    """
    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= max_chars))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not counts:
        return fit([], top)
    span = 1_000_003
    each = max(1, sample // len(counts))
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(span * min(1.0, each / r["n"]))) for r in counts], "lang string, share long")
    dice = F.pmod(F.xxhash64("id", "text", F.lit("language")), F.lit(span))
    chosen = known.withColumn("dice", dice).join(F.broadcast(shares), "lang").where("dice < share")
    rows = chosen.orderBy("dice", "id").limit(sample + sample // 10).select("lang", "text").collect()
    return fit([(r["lang"], r["text"]) for r in rows], top)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score. No shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(profiles)
    base = docs.drop("lang_pred", "score")
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                found = [held.value.predict(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    schema = base.limit(0).withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).schema
    return base.mapInArrow(run, schema)
