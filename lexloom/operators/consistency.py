"""Consistency over a whole corpus: how terms are rendered, conflicts, safe fixes with an audit, and their undoing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.regex import NON_WORD, WORD, quote_column
from lexloom.operators.qa import SAFE, SUGGESTED

_EDGE = f"(?:^|{NON_WORD})"
_END = f"(?:$|{NON_WORD})"


def first_words(text: Column, n: int) -> Column:
    """The first words of a text, marks of dialogue aside."""
    words = F.filter(F.split(F.regexp_replace(text, r'^[—"“\s]+', ""), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def _extract(text: Column, *pattern: Column) -> Column:
    found = F.call_function("regexp_extract", text, F.concat(F.lit("(?i)"), *pattern), F.lit(1))
    return F.when(found != "", found)


def variants(found: DataFrame) -> DataFrame:
    """How each segment renders each of its terms: the translation; else an alias; else words beside a part of the translation; else its first four words.

    found: (doc_id, chapter, target, term_id, term, target_term, kind, locked, has_target, aliases there), one row a segment and term.
    """
    t, words = F.col("target"), F.split(F.trim("target_term"), r"\s+")
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), " ")
    beside = F.when(F.size(words) > 1, F.coalesce(_extract(t, F.lit(f"{_EDGE}({WORD}+\\s+"), quote_column(rest), F.lit(f"){_END}")), _extract(t, F.lit(f"{_EDGE}("), quote_column(F.get(words, F.lit(0))), F.lit(f"\\s+{WORD}+){_END}"))))
    variant = F.when(F.col("has_target"), F.col("target_term")).otherwise(F.coalesce(F.get(F.sort_array("aliases"), F.lit(0)), beside, first_words(t, 4)))
    return found.select("doc_id", "chapter", "term_id", "term", "target_term", "kind", "locked", variant.alias("variant"))


def conflicts(rendered: DataFrame) -> DataFrame:
    """Terms rendered in more than one way: safe to fix if locked, else to be confirmed."""
    by_term = rendered.groupBy("term_id", "term", "target_term", "kind", "locked").agg(F.count_distinct("variant").alias("variants"), F.count("*").alias("n"), F.count_distinct("chapter").alias("chapters"))
    return by_term.where("variants > 1").withColumn("severity", F.when(F.col("locked"), SAFE).otherwise(SUGGESTED))


def _place(text: Column, old: Column) -> Column:
    """Where old first stands: as a whole word in either case, else anywhere; null if nowhere."""
    whole = F.concat(F.lit(f"(?is)^(.*?{_EDGE})"), quote_column(old), F.lit(_END))
    at = F.instr(F.lower(text), F.lower(old))
    return F.when(F.rlike(text, whole), F.length(F.call_function("regexp_extract", text, whole, F.lit(1)))).when((old != "") & (at > 0), at - 1)


_AUDIT = "array<struct<step:int,at:int,old:string,new:string>>"


def apply_fixes(segments: DataFrame, changes: DataFrame) -> DataFrame:
    """segments (doc_id, target) that a change alters, as (doc_id, fixed, audits). changes: (doc_id, step, old, new), made in the order of step.

    Each replaces the first place of its old text. An audit says where that was and what stood there, so rollback() needs no copies.
    """
    todo = changes.where(F.lower(F.trim("old")) != F.lower(F.trim("new"))).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("step", "old", "new"))).alias("todo"))
    start = F.struct(F.col("target").alias("text"), F.array().cast(_AUDIT).alias("audits"))

    def one(acc: Column, c: Column) -> Column:
        text, at = acc["text"], _place(acc["text"], c["old"])
        there = F.substring(text, at + 1, F.length(c["old"]))
        after = F.concat(F.substring(text, F.lit(1), at), c["new"], F.substring(text, at + F.length(c["old"]) + 1, F.length(text)))
        audit = F.struct(c["step"].cast("int").alias("step"), at.cast("int").alias("at"), there.alias("old"), c["new"].alias("new"))
        return F.when(at.isNull(), acc).otherwise(F.struct(after.alias("text"), F.concat(acc["audits"], F.array(audit)).alias("audits")))

    rows = segments.select("doc_id", "target").join(todo, "doc_id").withColumn("r", F.aggregate("todo", start, one))
    return rows.where(F.size("r.audits") > 0).select("doc_id", F.col("r.text").alias("fixed"), F.col("r.audits").alias("audits"))


def rollback(fixed: DataFrame) -> DataFrame:
    """(doc_id, restored, n): all changes of apply_fixes() undone, the last first."""

    def undo(text: Column, a: Column) -> Column:
        return F.concat(F.substring(text, F.lit(1), a["at"]), a["old"], F.substring(text, a["at"] + F.length(a["new"]) + 1, F.length(text)))

    return fixed.select("doc_id", F.aggregate(F.reverse("audits"), F.col("fixed"), undo).alias("restored"), F.size("audits").cast("long").alias("n"))
