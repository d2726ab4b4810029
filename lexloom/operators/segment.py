"""Segmentation folds: decisions that depend on what came before within one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS = 100
GROUP_WORDS = 120


def word_count(text: Column) -> Column:
    """Words between blanks."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def sentences(text: Column, blank: str = r"\s", also: str = "\x01") -> Column:
    """Sentences: an end mark, blanks, and no lower-case letter behind. also: a pattern that ends a sentence, too; it is dropped."""
    inner = blank if blank.startswith("\\") else blank[1:-1]
    ends = f"(?:(?<=[.!?])|(?<=[.!?][\"'”’)])){blank}+(?=[^a-z{inner}])" + (f"|{also}" if also else "")
    # not F.trim itself: transform would hand it the place of a sentence as the characters to trim
    return F.filter(F.transform(F.split(text, ends), lambda s: F.trim(s)), lambda s: s != "")


def pack_greedy(parts: Column, limit: int = MAX_WORDS, glue: str = " ") -> Column:
    """Consecutive parts joined while at most `limit` words; a longer part stands alone. A fold, no shuffle."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, part: Column) -> Column:
        words = word_count(part)
        fits = acc["open"].isNotNull() & (acc["n"] + words <= limit)
        closed = F.when(fits | acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"])))
        return F.struct(closed.alias("out"), F.when(fits, F.concat(acc["open"], F.lit(glue), part)).otherwise(part).alias("open"), F.when(fits, acc["n"] + words).otherwise(words).alias("n"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"]))))


def chunk_greedy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_WORDS) -> DataFrame:
    """(id, chunk_no, chunk): sentences of each text packed to at most `limit` words."""
    chunks = pack_greedy(sentences(F.col(text_col)), limit)
    return docs.select(id_col, F.posexplode(chunks).alias("chunk_no", "chunk"))


def group_short_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = GROUP_WORDS) -> DataFrame:
    """(id, group_no, text): lines of each text packed to at most `limit` words, with a blank line between them."""
    lines = F.filter(F.split(text_col, "\n"), lambda x: F.trim(x) != "")
    return docs.select(id_col, F.posexplode(pack_greedy(lines, limit, "\n\n")).alias("group_no", "text"))


def segment_chapter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segment_no, segment_id, kind, words, hash): groups of short paragraphs, long ones split."""
    groups = group_short_paragraphs(docs, id_col, text_col).withColumn("parts", F.when(word_count(F.col("text")) > GROUP_WORDS, pack_greedy(sentences(F.col("text")))).otherwise(F.array("text")))
    parts = groups.select(id_col, "group_no", F.size("parts").alias("total"), F.posexplode("parts").alias("part_no", "segment"))
    return parts.select(
        id_col, "group_no", "part_no", F.format_string("seg_%05d_%03d", "group_no", "part_no").alias("segment_id"),
        F.when(F.col("total") > 1, "split").otherwise("whole").alias("kind"), word_count(F.col("segment")).alias("words"),
        F.substring(F.sha2(F.regexp_replace(F.trim("segment"), r"\s+", " "), 256), 1, 16).alias("hash"),
    )
