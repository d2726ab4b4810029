"""Ranking of translation candidates on seven criteria, with what a segment's memories ask for.

Criteria of the text alone, the terms and the parts of names that a candidate holds are read in one pass in Python, before
any join, so that no text is shuffled unless it is asked for; those of terms, memory and characters compare what is relevant to
the segment, as one array a segment, with what the candidate holds. A dictionary of over matching.MOST_BYTES is joined instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_, eq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators import matching
from lexloom.session import ship_package

# Weights, English words that betray an untranslated text, words a sentence does not end with.
WEIGHTS = {"fidelity": 0.25, "naturalness": 0.15, "terminology": 0.20, "consistency": 0.15, "character_score": 0.10, "style": 0.08, "fluency": 0.07}
LEFT_OVER = ("the", "and", "with", "from", "that", "this", "because")
DANGLING = (" de", " com", " em", " para", " por", " sob", " sobre", ",")


_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
_ODD_BLANKS = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_DIGITS = re.compile(r"[0-9]+")
_LEFT_OVER = [(w, re.compile(rf"(?<!\w){w}(?!\w)")) for w in LEFT_OVER]
_TWICE = re.compile(r",[ \t\n\x0b\f\r]*,|\.[ \t\n\x0b\f\r]*\.[ \t\n\x0b\f\r]*\.")
OF_TEXT = "fidelity double, naturalness double, style double, fluency double"


def clip(score: Column) -> Column:
    """Between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def _clip(score: float) -> float:
    return max(0.0, min(1.0, score))


def _inner(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def numbers(text: str) -> set[str]:
    """Words that are digits alone."""
    return {m[0] for m in _DIGITS.finditer(text) if not _inner(text, m.end()) and not _inner(text, m.start() - 1)}


def _words(low: str) -> list[str]:
    """Words between blanks; str.split where it takes the same blanks."""
    return [x for x in _BLANKS.split(low) if x] if _ODD_BLANKS.search(low) else low.split()


def fidelity(source: str, target: str, asked: set[str] | None = None, low: str | None = None) -> float:
    """Length, numbers, question and exclamation marks, words left in English. asked, low: the source's numbers and the target in lower case, where known."""
    if source == "":
        return 1.0
    asked, low = numbers(source) if asked is None else asked, target.lower() if low is None else low
    lost = min(0.3, 0.15 * len(asked - numbers(target))) if asked else 0.0
    marks = [0.1 if m in source and m not in target else 0.0 for m in "?!"]
    kept = min(0.4, 0.15 * sum(w in low and bool(own.search(low)) for w, own in _LEFT_OVER))
    ratio = len(target) / max(1, len(source))
    return _clip(1.0 - (0.4 if ratio < 0.4 else 0.3 if ratio > 2.5 else 0.0) - lost - marks[0] - marks[1] - kept)


def naturalness(target: str, low: str | None = None) -> float:
    """Words and pairs of words said twice in a row, marks said twice. low: the target in lower case, where known."""
    w = _words(target.lower() if low is None else low)
    if not w:
        return 0.0
    twice = sum(len(a) > 1 for a, same in zip(w, map(eq, w, w[1:]), strict=False) if same)
    again = list(map(eq, w, w[2:]))
    loop = any(map(and_, again, again[1:]))
    return _clip(1.0 - 0.25 * twice - (0.35 if loop else 0.0) - (0.15 if _TWICE.search(target) else 0.0))


def style(target: str) -> float:
    """Dialogue opened by a dash, not by a quote."""
    t = target.lstrip(" \t\n\x0b\f\r")
    return _clip(1.0 - (0.15 if t.startswith(('"', "'")) else 0.0) + (0.05 if t.startswith(("—", "- ")) else 0.0))


def fluency(target: str) -> float:
    """A sentence that ends, and brackets that close."""
    t = target.strip(" \t\n\x0b\f\r")
    if not t:
        return 0.0
    return _clip(1.0 - (0.3 if t.endswith(DANGLING) else 0.0) - (0.2 if target.count("(") != target.count(")") else 0.0) - (0.2 if target.count("[") != target.count("]") else 0.0))


def of_text(df: DataFrame, terms: list[str] = (), parts: list[str] = ()) -> DataFrame:
    """df (source, target) with the four criteria of the texts alone, and with the terms (_held: whole words, in lower case) and
    parts (_parts: anywhere, in lower case) that the target holds. Each text is read once; all are null where one is null.
    """
    spark = df.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast((list(terms), list(parts)))
    mark = sent._jbroadcast.id()
    names = [c.split(" ")[0] for c in OF_TEXT.split(", ")]

    @F.pandas_udf(f"{OF_TEXT}, _held array<string>, _parts array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own_terms, own_parts = sent.value
        find = matching.matcher(mark, [(t, False) for t in own_terms]).find
        for sources, targets in batches:
            rows, last, asked = [], None, set()
            for s, t in zip(sources, targets, strict=True):
                if s is None or t is None:
                    rows.append((None,) * 6)
                    continue
                if s != last:
                    last, asked = s, numbers(s)
                low = t.lower()
                held = [own_terms[k] for k in find(t)] if own_terms else []
                rows.append((fidelity(s, t, asked, low), naturalness(t, low), style(t), fluency(t), held, [p for p in own_parts if p in low]))
            out = pd.DataFrame(rows, columns=[*names, "_held", "_parts"])
            yield out.astype(dict.fromkeys(names, "float64"))

    return df.withColumn("_text", run("source", "target")).withColumns({c: F.col(f"_text.{c}") for c in (*names, "_held", "_parts")}).drop("_text")


def _small(words: DataFrame) -> list[str] | None:
    """Distinct words (term) if they take at most matching.MOST_BYTES."""
    size = words.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    return [r["term"] for r in words.orderBy("term").collect()] if size <= matching.MOST_BYTES else None


def score(candidates: DataFrame, terms: DataFrame, memory: DataFrame, names: DataFrame) -> DataFrame:
    """candidates (doc_id, cand, source, target) with the seven scores and final_score.

    terms: (doc_id, term, target_term), locked terms of the segment; memory: (doc_id, target_term), its locked entries; names:
    (doc_id, name), its characters. Entries are looked for in a candidate as whole words, in either case.
    """
    wanted = terms.select("doc_id", F.lower("target_term").alias("w")).groupBy("doc_id").agg(F.collect_set("w").alias("_wanted"))
    unwanted = terms.where(F.lower("term") != F.lower("target_term")).select("doc_id", F.lower("term").alias("w")).groupBy("doc_id").agg(F.collect_set("w").alias("_unwanted"))
    known = memory.select("doc_id", F.lower("target_term").alias("w")).groupBy("doc_id").agg(F.collect_set("w").alias("_memory"))
    parts = F.filter(F.split(F.lower("name"), r"\s+"), lambda w: F.length(w) > 2)
    people = names.where(F.size(F.split(F.trim("name"), r"\s+")) > 1).select("doc_id", F.struct("name", parts.alias("parts")).alias("n")).groupBy("doc_id").agg(F.collect_set("n").alias("_people"))
    words = terms.select(F.explode(F.array("term", "target_term")).alias("w")).unionByName(memory.select(F.col("target_term").alias("w"))).select(F.lower("w").alias("term")).where("term IS NOT NULL").distinct()
    pieces = names.where(F.size(F.split(F.trim("name"), r"\s+")) > 1).select(F.explode(parts).alias("term")).distinct()
    few, few_pieces = _small(words), _small(pieces)
    rows = of_text(candidates, few or [], few_pieces or [])
    if few is None:
        held = matching.find_terms(candidates, words.withColumn("k", F.lit(0)), "target", ("doc_id", "cand"), ("k",)).groupBy("doc_id", "cand").agg(F.collect_set("term").alias("_held"))
        rows = rows.drop("_held").join(held, ["doc_id", "cand"], "left")
    partial = lambda present: F.size(F.filter("_people", lambda n: (present(n) > 0) & (present(n) < F.size(n["parts"]))))
    if few_pieces is None:
        low = F.lower("target")
        named = candidates.select("doc_id", "cand", "target").join(people, "doc_id").select("doc_id", "cand", partial(lambda n: F.size(F.filter(n["parts"], lambda w: low.contains(w)))).alias("_partial"))
        rows = rows.join(named, ["doc_id", "cand"], "left")
    else:
        rows = rows.join(people, "doc_id", "left").withColumn("_partial", partial(lambda n: F.size(F.filter(n["parts"], lambda w: F.array_contains("_parts", w)))))
    for side in (wanted, unwanted, known):
        rows = rows.join(side, "doc_id", "left")
    none = F.array().cast("array<string>")
    got = {c: F.coalesce(c, none) for c in ("_held", "_wanted", "_unwanted", "_memory")}
    rows = rows.withColumns(got)
    rows = rows.withColumns(
        {
            "terminology": clip(1.0 - 0.4 * F.size(F.array_except("_wanted", "_held")) - 0.35 * F.size(F.array_intersect("_unwanted", "_held"))),
            "consistency": clip(1.0 - 0.2 * F.size(F.array_except("_memory", "_held"))),
            "character_score": clip(1.0 - 0.15 * F.coalesce("_partial", F.lit(0))),
        }
    )
    final = reduce(lambda a, b: a + b, (F.lit(w) * F.col(k) for k, w in WEIGHTS.items()))
    return rows.select(*candidates.columns, *WEIGHTS, F.round(clip(final), 6).alias("final_score"))


def rank(scored: DataFrame) -> DataFrame:
    """scored with `rank` within the segment: the best score, then the shorter text (column size, else target's length), then the smaller number."""
    size = F.col("size") if "size" in scored.columns else F.length("target")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("final_score"), size, "cand")))
