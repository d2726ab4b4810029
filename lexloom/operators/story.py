"""Look-ups in a story's memory: relations, facts and references. Filters on given ids, which reach the scan; recording is a partial maximum.

relations: (src, tgt, rel_type, chapter, inferred, ...); facts: (category, entities array, locked, inferred, ...); references:
(src, tgt, ...). None as a parameter asks for nothing. A null id, category or flag never fits a question.

violations() checks texts against the negative facts. Texts meet facts by equal words, and statements that are alike meet a text once.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators import memory

RELATION_KEY = ("src", "tgt", "rel_type", "chapter")
#: What makes a statement negative, wherever it stands in it, and its words that restrict nothing.
MARKERS = "não|proibido|nunca|cannot|never|impossível"
IDLE = ("não", "pode", "deve", "proibido", "nunca", "cannot", "never", "impossível", "regra", "universo", "fora", "para", "sobre")
#: What negates the word behind it, or the one behind that.
NEGATIONS = "não|nunca|jamais|proibido|impossível de|not|never|no"
WORD, BLANK = "[\\p{L}\\p{N}_]", "[\\t\\n\\x0B\\f\\r \\x1C-\\x1F\\x{85}\\p{Z}]"


def record(relations: DataFrame, incoming: DataFrame, order: str = "rel_id") -> DataFrame:
    """relations after incoming ones: the last by `order` of each pair, kind and chapter; an incoming one replaces what is there."""
    both = relations.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return memory.latest(both, RELATION_KEY, F.col("_new"), F.col(order)).drop("_new")


def between(relations: DataFrame, ids: Collection) -> DataFrame:
    """Relations with both ends among ids; none if these are fewer than two."""
    chosen = sorted(set(ids))
    if len(chosen) < 2:
        return relations.where(F.lit(False))
    return relations.where(F.col("src").isin(*chosen) & F.col("tgt").isin(*chosen))


def _flag(column: str, wanted: bool | None) -> Column:
    return F.lit(True) if wanted is None else F.col(column) == F.lit(wanted)


def of(relations: DataFrame, person, inferred: bool | None = None) -> DataFrame:
    """Relations from or to a person; explicit or inferred ones alone if asked."""
    return relations.where(((F.col("src") == person) | (F.col("tgt") == person)) & _flag("inferred", inferred))


def facts(rows: DataFrame, category: str | None = None, entity: str | None = None, locked: bool | None = None, inferred: bool | None = None) -> DataFrame:
    """Facts of a category, about an entity, locked or not, explicit or inferred, as far as asked."""
    about = F.lit(True) if entity is None else F.array_contains("entities", entity)
    kind = F.lit(True) if category is None else F.col("category") == category
    return rows.where(kind & about & _flag("locked", locked) & _flag("inferred", inferred))


def references(rows: DataFrame, unit) -> DataFrame:
    """References from or to a unit."""
    return rows.where((F.col("src") == unit) | (F.col("tgt") == unit))


def restricted(statement: str) -> str:
    """SQL of the words a negative statement restricts, in order: those of four letters or more that are not idle; none of others."""
    idle = ", ".join(f"'{w}'" for w in IDLE)
    return f"IF(regexp_like(lower({statement}), r'{MARKERS}'), filter(regexp_extract_all(lower({statement}), r'{WORD}{{4,}}', 0), w -> w NOT IN ({idle})), CAST(array() AS array<string>))"


def stated(text: str) -> str:
    """SQL of the distinct words of four letters or more in a text, but those that are negated in some place: right behind a negation or one word on."""
    no = f"(?<!{WORD})(?:{NEGATIONS})"
    negated = ", ".join(f"regexp_extract_all(lower({text}), r'{no}(?={BLANK}++{between}({WORD}++))', 1)" for between in ("", f"{WORD}++{BLANK}++"))
    words = f"regexp_extract_all(lower({text}), r'{WORD}{{4,}}', 0)"
    return f"IF(regexp_like(lower({text}), r'{no}{BLANK}'), array_except({words}, concat({negated})), array_distinct({words}))"


def violations(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(fact_id, doc_id, word): facts (fact_id, statement, locked) that texts (doc_id, text) may break, with the first restricted word a text states. Locked facts, or all if none is locked."""
    locked = rows.agg(F.coalesce(F.bool_or("locked"), F.lit(False)).alias("any"))
    chosen = rows.crossJoin(F.broadcast(locked)).where("locked OR NOT any").select("fact_id", "statement")
    words = chosen.select("statement").distinct().select("statement", F.posexplode(F.expr(restricted("statement"))).alias("pos", "word"))
    found = texts.select("doc_id", F.explode(F.expr(stated("text"))).alias("word")).join(words, "word")
    return found.groupBy("doc_id", "statement").agg(F.min_by("word", "pos").alias("word")).join(chosen, "statement").select("fact_id", "doc_id", "word")
