"""Back-translation as evidence: the source against what a model makes of the translation."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.regex import WORD
from lexloom.operators.semantic import whole
from lexloom.session import ship_package

# Negations of this check and known agents.
NEGATED = r"not|never|neither|no\s+one|nobody|nothing|refused"
AGENTS = ("holmes", "watson", "lestrade", "margaret")
ORDERS, BETA = 4, 2.0


def token_f1(a: str, b: str) -> float:
    """F1 of the words of two texts, each counted as often as it occurs."""
    import re

    x, y = (re.findall(r"\w+", t.lower()) for t in (a, b))
    common = sum((Counter(x) & Counter(y)).values())
    return 2 * common / (len(x) + len(y)) if common else 0.0


def chrf(reference: str, hypothesis: str, orders: int = ORDERS, beta: float = BETA) -> float:
    """F-score of the character n-grams of 1 to `orders` of both texts, all orders in one count; linear but for sorting."""
    a, b = reference.strip().lower(), hypothesis.strip().lower()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    sides = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b)]
    cut = sides[0].size
    letters = np.unique(np.concatenate(sides), return_inverse=True)[1].astype(np.int64)
    grams, common, totals = letters, 0, [0, 0]
    for n in range(1, orders + 1):
        if n > 1:  # a gram is the one before and a letter; those across the border of the sides are not counted
            if grams.size < 2:
                break
            grams = np.unique(grams[:-1] * (letters.max() + 1) + letters[n - 1 :], return_inverse=True)[1].astype(np.int64)
        own = grams[: max(0, cut - n + 1)], grams[cut:]
        size = int(grams.max()) + 1
        counts = [np.bincount(x, minlength=size) for x in own]
        common += int(np.minimum(*counts).sum())
        totals = [t + x.size for t, x in zip(totals, own, strict=True)]
    if not common:
        return 0.0
    r, p = common / totals[0], common / totals[1]
    return (1 + beta * beta) * p * r / (beta * beta * p + r)


def scores(source: Column, back: Column) -> Column:
    """struct<f1, chrf> of two texts."""

    @F.pandas_udf("f1 double, chrf double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        pairs = [((a or "").strip(), (b or "").strip()) for a, b in zip(x, y, strict=True)]
        return pd.DataFrame({"f1": [token_f1(a, b) for a, b in pairs], "chrf": [chrf(a, b) for a, b in pairs]})

    return run(source, back)


def verify(df: DataFrame, back: str = "back") -> DataFrame:
    """df (with source and the back-translation) with f1, chrf, negation_kept, subject_kept, short and issue.

    Wording may differ without an issue; a lost negation, another subject or agent, or under 0.45 of the words is one.
    """
    ship_package(df.sparkSession)
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    rows = df.withColumns({"_s": F.lower(strip(F.col("source"))), "_b": F.lower(strip(F.col(back)))}).withColumn("_m", scores(F.col("source"), F.col(back)))
    s, b = F.col("_s"), F.col("_b")
    first = lambda c: F.regexp_extract(c, rf"^[,.]*({WORD}+)[,.]*(\s|$)", 1)
    swapped = ((first(s) == "he") & (first(b) == "she")) | ((first(s) == "she") & (first(b) == "he"))
    agent = lambda c: F.coalesce(*[F.when(c.contains(a), F.lit(a)) for a in AGENTS])
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\S+"), 0))
    out = rows.withColumns(
        {
            "f1": F.col("_m.f1"), "chrf": F.col("_m.chrf"), "negation_kept": s.rlike(whole(NEGATED)) == b.rlike(whole(NEGATED)),
            "subject_kept": ~swapped & F.coalesce(agent(s) == agent(b), F.lit(True)), "short": (words(s) >= 6) & (words(b) < 0.45 * words(s)),
        }
    )
    return out.withColumn("issue", ~F.col("negation_kept") | ~F.col("subject_kept") | F.col("short")).drop("_s", "_b", "_m")
