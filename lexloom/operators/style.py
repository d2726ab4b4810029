"""A style bible as a table of rules, filled by decisions and by inference from texts, and its contradictions.

rules: (rule, value, locked, inferred, confidence, evidence). A decision goes through memory.upsert(), so a locked rule stays; an
inference never replaces a decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import memory

# Names under which a rule is asked for.
SYNONYMS = {"dialogue": "dialogue_style", "dialogo": "dialogue_style", "titles": "title_treatment", "titulos": "title_treatment", "formality": "formality_level", "formalidade": "formality_level", "profanity": "profanity_policy", "palavroes": "profanity_policy"}
RULES = "rule string, value string, locked boolean, inferred boolean, confidence double, evidence array<string>"
_VALUES = ("value", "inferred", "confidence")


def set_rules(rules: DataFrame, decisions: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rules after the decisions, outcomes by rule)."""
    after, outcomes = memory.upsert(rules, decisions, ("rule",), _VALUES, ("evidence",), force)
    return after, outcomes


def infer(rules: DataFrame, observed: DataFrame, least: float = 0.6) -> DataFrame:
    """rules with what texts show: observed (rule, value, evidence) rows. The most frequent value of a rule, if its share is `least` or more.

    A rule that was decided keeps its value and gains the evidence of that value alone.
    """
    counts = observed.groupBy("rule", "value").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("evidence")), 1, 5).alias("evidence"))
    total = counts.groupBy("rule").agg(F.sum("n").alias("total"), F.max(F.struct("n", "value")).alias("m"))
    best = counts.join(total, "rule").where((F.col("value") == F.col("m.value")) & (F.col("n") >= least * F.col("total")))
    new = best.select("rule", "value", F.lit(False).alias("locked"), F.lit(True).alias("inferred"), F.round(F.col("n") / F.col("total"), 4).alias("confidence"), "evidence")
    decided = rules.where("NOT inferred").select("rule", F.col("value").alias("own"))
    usable = new.join(decided, "rule", "left")
    fresh = usable.where("own IS NULL").drop("own")
    backed = usable.where("own = value").drop("own")
    after, _ = memory.upsert(rules, fresh, ("rule",), _VALUES, ("evidence",))
    more = backed.select("rule", F.col("evidence").alias("more"))
    return after.join(more, "rule", "left").withColumn("evidence", F.array_sort(F.array_distinct(F.concat("evidence", F.coalesce("more", F.array().cast("array<string>")))))).drop("more")


def lookup(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (name) with rule, value and locked, by name or synonym."""
    names = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    low = F.lower(F.trim("name"))
    return asked.withColumn("rule", F.coalesce(names[low], low)).join(rules.select("rule", "value", "locked"), "rule", "left").select("name", "rule", "value", "locked")


def contradictions(rules: DataFrame, observed: DataFrame) -> DataFrame:
    """(rule, value, other, n, severity): values that texts show against a rule; an inferred rule that is locked is one as well."""
    against = observed.groupBy("rule", F.col("value").alias("other")).agg(F.count("*").alias("n")).join(rules, "rule").where(F.col("other") != F.col("value"))
    severity = F.when(F.col("locked"), "error").otherwise("warning")
    shown = against.select("rule", "value", "other", "n", severity.alias("severity"))
    unsure = rules.where("inferred AND locked").select("rule", "value", F.lit("inferred and locked").alias("other"), F.lit(0).cast("long").alias("n"), F.lit("warning").alias("severity"))
    return shown.unionByName(unsure)
