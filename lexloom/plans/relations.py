"""Queries of relations, facts and references, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import story
from lexloom.plans import dialect
from lexloom.plans import story as story_plans  # noqa: F401  its views are read here
from lexloom.session import table

CAST = (1, 2, 3)


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.query("SELECT rel_id, seq, src, tgt, rel_type, chapter, inferred FROM relations", "")(spark, sf_dir)


def relation_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations after those of the returned lines came again in the next chapter."""
    rows = _relations(spark, sf_dir)
    again = rows.where("inferred").withColumns({"chapter": F.col("chapter") + 1, "inferred": F.lit(False)})
    return story.record(rows, again).select(*story.RELATION_KEY, "rel_id")


def relation_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations within a cast."""
    return story.between(_relations(spark, sf_dir), CAST).select("rel_id", "seq", "src", "tgt")


def relation_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit relations of one person."""
    return story.of(_relations(spark, sf_dir), 7, inferred=False).select("rel_id", "seq", "src", "tgt", "rel_type")


def facts_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit locked facts about an entity."""
    rows = dialect.query("SELECT fact_id, category, subject, locked, inferred FROM facts", "")(spark, sf_dir)
    return story.facts(rows.withColumn("entities", F.array("subject", "category")), entity="en", locked=True, inferred=False).select("fact_id", "category")


def xrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References from or to a unit; orders stand for units that refer, parts for those referred to."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("tgt"), F.col("l_linenumber").alias("seq"))
    return story.references(rows, 5)


QUERIES = {f.__name__: f for f in (relation_record, relation_between, relation_of, facts_filter, xrefs)}
_KIND = "CASE l_linenumber % 3 WHEN 0 THEN 'friend' WHEN 1 THEN 'enemy' ELSE 'sibling' END"
_ENDS = "l_orderkey AS rel_id, l_partkey % 40 AS src, l_suppkey % 40 AS tgt"
ORACLES = {
    "relation_record": f"""WITH r AS (SELECT {_ENDS}, {_KIND} AS rel_type, l_orderkey % 10 AS chapter, l_returnflag = 'R' AS again FROM lineitem),
  united AS (SELECT src, tgt, rel_type, chapter, rel_id, 0 AS new FROM r UNION ALL SELECT src, tgt, rel_type, chapter + 1, rel_id, 1 FROM r WHERE again)
  SELECT src, tgt, rel_type, chapter, rel_id FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt, rel_type, chapter ORDER BY new DESC, rel_id DESC) AS k FROM united) x WHERE k = 1""",
    "relation_between": f"SELECT * FROM (SELECT {_ENDS}, l_linenumber AS seq FROM lineitem) x WHERE list_contains([1, 2, 3], src) AND list_contains([1, 2, 3], tgt)",
    "relation_of": f"SELECT rel_id, seq, src, tgt, rel_type FROM (SELECT {_ENDS}, l_linenumber AS seq, {_KIND} AS rel_type FROM lineitem WHERE l_returnflag <> 'R') x WHERE 7 IN (src, tgt)",
    "facts_filter": "SELECT doc_id AS fact_id, source AS category FROM documents WHERE (lang = 'en' OR source = 'en') AND doc_id % 5 = 0 AND doc_id % 4 <> 0",
    "xrefs": "SELECT l_orderkey AS src, l_partkey AS tgt, l_linenumber AS seq FROM lineitem WHERE 5 IN (l_orderkey, l_partkey)",
}
