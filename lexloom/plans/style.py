"""Queries of the style bible and of memories' upserts, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import memory, style
from lexloom.plans import fixtures as fx
from lexloom.plans.fixtures import GLOSSARY_SQL, PAIRS_SQL, values
from lexloom.session import table

#: Rules that are there, and decisions that come in.
RULES = [("dialogue_style", "travessão", True, False, 1.0), ("title_treatment", "traduzir", False, False, 0.9), ("formality_level", "formal", False, True, 0.6), ("number_style", "arábico", True, True, 0.7)]
DECISIONS = [("dialogue_style", "aspas", False, False, 1.0), ("title_treatment", "manter", True, False, 1.0), ("formality_level", "formal", False, True, 0.6), ("profanity_policy", "manter", False, False, 0.8)]
ASKED = ["dialogue", "Titles", "formality_level", "palavroes", "unknown"]


def _rows(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(*r, [f"editor {r[1]}"]) for r in rows], style.RULES)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pairs' targets show: how dialogue opens, and the form of address."""
    rows = fx.pairs(spark, sf_dir).select("doc_id", F.lower("target").alias("t"))
    opening = F.when(F.col("t").rlike('^["“]'), "aspas").when(F.col("t").rlike("^[—–-]"), "travessão")
    address = F.when(F.col("t").rlike(r"(^|[^\p{L}])você($|[^\p{L}])"), "informal").when(F.col("t").rlike(r"(^|[^\p{L}])senhor(a|es)?($|[^\p{L}])"), "formal").otherwise("neutro")
    both = F.explode(F.array(F.struct(F.lit("dialogue_style").alias("rule"), opening.alias("value")), F.struct(F.lit("formality_level").alias("rule"), address.alias("value")))).alias("x")
    return rows.select("doc_id", both).where("x.value IS NOT NULL").select("x.rule", "x.value", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("evidence"))


def style_set_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions against the rules that are there: what came of each, and the rule after it."""
    after, outcomes = style.set_rules(_rows(spark, RULES), _rows(spark, DECISIONS))
    return outcomes.join(after, "rule").select("rule", "outcome", "value", "locked", F.size("evidence").cast("long").alias("evidence"))


def style_get_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by name or synonym."""
    return style.lookup(_rows(spark, RULES), spark.createDataFrame([(a,) for a in ASKED], "name string"))


def style_explicit_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules decided and inferred, after inference from the texts."""
    return style.infer(_rows(spark, RULES), observed(spark, sf_dir)).select("rule", "value", "inferred", F.round("confidence", 4).alias("confidence"))


def style_add_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that show each value of a rule."""
    return observed(spark, sf_dir).groupBy("rule", "value").agg(F.count("*").alias("n"), F.min("evidence").alias("first"))


def style_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with the decided ones locked."""
    return memory.lock(_rows(spark, RULES), ~F.col("inferred")).select("rule", "locked")


def style_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that texts show against a rule, and rules locked without a decision."""
    return style.contradictions(_rows(spark, RULES), observed(spark, sf_dir))


def _incoming(spark: SparkSession) -> DataFrame:
    rows = fx.glossary(spark).where("term_id <> 2").select("term_id", F.upper("target_term").alias("target_term"), F.lit("term").alias("kind"), F.lit(False).alias("locked"), F.array(F.lower("term")).alias("aliases"))
    return rows.unionByName(spark.createDataFrame([(99, "novo", "term", True, ["new"])], "term_id int, target_term string, kind string, locked boolean, aliases array<string>"))


def glossary_upsert_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed entries: locked ones are refused, aliases united, new ones added."""
    after, outcomes = memory.upsert(fx.glossary(spark), _incoming(spark), ("term_id",), ("target_term", "kind"), ("aliases",))
    return after.join(outcomes, "term_id", "left").select("term_id", "target_term", "kind", "locked", F.array_join("aliases", "|").alias("aliases"), F.coalesce("outcome", F.lit(memory.KEPT)).alias("outcome"))


def glossary_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a forced upsert changes, one row each."""
    before = fx.glossary(spark)
    after, _ = memory.upsert(before, _incoming(spark), ("term_id",), ("target_term", "kind"), ("aliases",), force=True)
    return memory.differences(before, after, ("term_id",), ("target_term", "kind"))


def glossary_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that are another entry's term."""
    return memory.alias_conflicts(fx.glossary(spark), "term_id", "term").select("term_id", "alias", F.col("other").alias("other_id"))


def tm_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory after every third entry came again with another translation: locked ones keep theirs."""
    entries = fx.tm(spark, sf_dir).select("tm_id", "target_term", "status", "locked")
    incoming = entries.where("tm_id % 3 = 0").select("tm_id", F.concat(F.lit("new "), "target_term").alias("target_term"), F.lit("approved").alias("status"), F.lit(False).alias("locked"))
    after, outcomes = memory.upsert(entries, incoming, ("tm_id",), ("target_term", "status"))
    return after.join(outcomes, "tm_id").select("tm_id", F.md5("target_term").alias("target_md5"), "status", "locked", "outcome")


def sink_sqlite_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each user's row; what is never overwritten is from the first."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    last = memory.latest(events, ("user_id",), F.col("ts"), F.col("event_id"))
    first = memory.latest(events, ("user_id",), -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")).select("user_id", F.col("event_type").alias("original_type"))
    return last.join(first, "user_id").select("user_id", "event_id", "event_type", "original_type")


QUERIES = {f.__name__: f for f in (style_set_rule, style_get_rule, style_explicit_inferred, style_add_evidence, style_lock, style_contradictions, glossary_upsert_locked, glossary_update, glossary_conflicts, tm_upsert, sink_sqlite_upsert)}

_RULES = f"rules AS (SELECT * FROM {values(RULES, 'rule, value, locked, inferred, confidence')}), incoming AS (SELECT * FROM {values(DECISIONS, 'rule, value, locked, inferred, confidence')})"
_L = "[^\\p{L}]"
_OBSERVED = f"""observed AS (SELECT rule, value, concat('doc ', doc_id) AS evidence FROM (SELECT doc_id, 'dialogue_style' AS rule, CASE WHEN regexp_matches(target, '^["“]') THEN 'aspas' WHEN regexp_matches(target, '^[—–-]') THEN 'travessão' END AS value FROM pairs
  UNION ALL SELECT doc_id, 'formality_level', CASE WHEN regexp_matches(lower(target), '(^|{_L})você($|{_L})') THEN 'informal' WHEN regexp_matches(lower(target), '(^|{_L})senhor(a|es)?($|{_L})') THEN 'formal' ELSE 'neutro' END FROM pairs) WHERE value IS NOT NULL)"""
_ALL = f"WITH {PAIRS_SQL}, {_RULES}, {_OBSERVED}"
_SYNONYMS = values(list(style.SYNONYMS.items()), "name, rule")
_UP = "(SELECT term_id, upper(target_term) AS t, lower(term) AS a FROM glossary WHERE term_id <> 2)"
ORACLES = {
    "style_set_rule": f"WITH {_RULES} SELECT i.rule, CASE WHEN r.rule IS NULL THEN 'added' WHEN r.value = i.value AND r.confidence = i.confidence THEN 'unchanged' WHEN r.locked THEN 'rejected' ELSE 'updated' END AS outcome, CASE WHEN r.locked THEN r.value ELSE i.value END AS value, CASE WHEN r.rule IS NULL THEN i.locked ELSE r.locked OR i.locked END AS locked, CASE WHEN r.rule IS NULL OR r.value = i.value THEN 1 ELSE 2 END AS evidence FROM incoming i LEFT JOIN rules r ON r.rule = i.rule",
    "style_get_rule": f"WITH {_RULES} SELECT a.name, coalesce(s.rule, lower(a.name)) AS rule, r.value, r.locked FROM {values([(a,) for a in ASKED], 'name')} a LEFT JOIN {_SYNONYMS} s ON s.name = lower(a.name) LEFT JOIN rules r ON r.rule = coalesce(s.rule, lower(a.name))",
    "style_explicit_inferred": f"{_ALL}, shares AS (SELECT rule, value, count(*) / sum(count(*)) OVER (PARTITION BY rule) AS share FROM observed GROUP BY rule, value), best AS (SELECT rule, arg_max(value, (share, value)) AS value, max(share) AS share FROM shares GROUP BY rule HAVING max(share) >= 0.6) SELECT coalesce(r.rule, b.rule) AS rule, CASE WHEN b.rule IS NOT NULL AND r.inferred AND NOT r.locked THEN b.value ELSE r.value END AS value, r.inferred, CAST(round(CASE WHEN b.rule IS NOT NULL AND r.inferred AND NOT r.locked THEN b.share ELSE r.confidence END, 4) AS DOUBLE) AS confidence FROM rules r LEFT JOIN best b ON b.rule = r.rule",
    "style_add_evidence": f"{_ALL} SELECT rule, value, count(*) AS n, min(evidence) AS first FROM observed GROUP BY rule, value",
    "style_lock": f"WITH {_RULES} SELECT rule, locked OR NOT inferred AS locked FROM rules",
    "style_contradictions": f"{_ALL} SELECT r.rule, r.value, o.value AS other, count(*) AS n, CASE WHEN r.locked THEN 'error' ELSE 'warning' END AS severity FROM rules r JOIN observed o ON o.rule = r.rule AND o.value <> r.value GROUP BY ALL UNION ALL SELECT rule, value, 'inferred and locked', 0, 'warning' FROM rules WHERE inferred AND locked",
    "glossary_upsert_locked": f"WITH {GLOSSARY_SQL} SELECT g.term_id, CASE WHEN u.term_id IS NULL OR g.locked THEN g.target_term ELSE u.t END AS target_term, CASE WHEN u.term_id IS NULL OR g.locked THEN g.kind ELSE 'term' END AS kind, g.locked, array_to_string(list_sort(list_distinct(list_concat(g.aliases, CASE WHEN u.term_id IS NULL THEN [] ELSE [u.a] END))), '|') AS aliases, CASE WHEN u.term_id IS NULL THEN 'kept' WHEN g.target_term = u.t AND g.kind = 'term' THEN 'unchanged' WHEN g.locked THEN 'rejected' ELSE 'updated' END AS outcome FROM glossary g LEFT JOIN {_UP} u ON u.term_id = g.term_id UNION ALL SELECT 99, 'novo', 'term', true, 'new', 'added'",
    "glossary_update": f"WITH {GLOSSARY_SQL} SELECT g.term_id, 'target_term' AS field, g.target_term AS old_value, u.t AS new_value FROM glossary g JOIN {_UP} u ON u.term_id = g.term_id WHERE g.target_term <> u.t UNION ALL SELECT term_id, 'kind', kind, 'term' FROM glossary WHERE term_id <> 2 AND kind <> 'term'",
    "glossary_conflicts": f"WITH {GLOSSARY_SQL} SELECT a.term_id, a.alias, b.term_id AS other_id FROM (SELECT term_id, unnest(aliases) AS alias FROM glossary) a JOIN glossary b ON lower(b.term) = lower(a.alias) WHERE a.term_id <> b.term_id",
    "tm_upsert": f"WITH {fx.TM_SQL} SELECT tm_id, md5(CASE WHEN locked THEN target_term ELSE concat('new ', target_term) END) AS target_md5, CASE WHEN locked THEN status ELSE 'approved' END AS status, locked, CASE WHEN locked THEN 'rejected' ELSE 'updated' END AS outcome FROM tm WHERE tm_id % 3 = 0",
    "sink_sqlite_upsert": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_min(event_type, (ts, event_id)) AS original_type FROM events GROUP BY user_id",
}
