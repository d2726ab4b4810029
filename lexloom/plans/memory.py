"""Queries on memories that need more than one statement: searches both ways, orders of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import matching, ranks
from lexloom.plans import fixtures as fx
from lexloom.plans.fixtures import LINES_SQL, PAIRS_SQL, TM_SQL
from lexloom.session import table

LEAST_CONFIDENCE = 0.3


def tm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory entries that a line is, holds or is in, of enough confidence; as whole words, in either case."""
    lines = fx.lines(spark, sf_dir).select("doc_id", "line_no", "line")
    entries = fx.tm(spark, sf_dir).where(F.col("confidence") >= LEAST_CONFIDENCE).select("tm_id", F.col("source_term").alias("term"))
    inside = matching.find_terms(lines, entries, "line", ("doc_id", "line_no"), ("tm_id",)).select("doc_id", "line_no", "tm_id")
    texts = lines.where(F.trim("line") != "").select(F.lower("line").alias("term")).distinct().withColumn("k", F.lit(0))
    around = matching.find_terms(entries.withColumnRenamed("term", "text"), texts, "text", ("tm_id",), ("k",)).select("tm_id", F.col("term").alias("low"))
    around = lines.withColumn("low", F.lower("line")).join(around, "low").select("doc_id", "line_no", "tm_id")
    found = inside.unionByName(around).distinct().join(lines, ["doc_id", "line_no"]).join(entries, "tm_id")
    exact = F.lower(F.trim("line")) == F.lower(F.trim("term"))
    return found.select("doc_id", "line_no", "tm_id", F.when(exact, "exact").otherwise("partial").alias("kind"))


def tm_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by occurrences."""
    return ranks.global_rank(fx.tm(spark, sf_dir).select("tm_id", "occurrences"), F.desc("occurrences"), F.asc("tm_id"))


def pending_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments to translate, in order."""
    rows = fx.pairs(spark, sf_dir).where("doc_id % 4 IN (0, 1)").select("doc_id", "chapter", "seq")
    return ranks.global_rank(rows, F.asc("chapter"), F.asc("seq"))


def linear_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters and units of each language's book in reading order."""
    rows = ranks.global_rank(fx.lines(spark, sf_dir).select("doc_id", "line_no", "lang"), F.asc("lang"), F.asc("doc_id"), F.asc("line_no"), name="at")
    first = rows.groupBy("lang").agg(F.min("at").alias("first"))
    return rows.join(F.broadcast(first), rows["lang"].eqNullSafe(first["lang"])).select("doc_id", "line_no", (F.col("at") - F.col("first") + 1).alias("pos"))


def bench_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and 95th percentile by rank of each type of event."""
    events = table(spark, sf_dir, "events").select("event_type", "value", "event_id")
    rows = ranks.global_rank(events, F.asc("event_type"), F.asc("value"), F.asc("event_id"))
    by_type = rows.groupBy("event_type").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    at = by_type.withColumn("at", F.col("first") + F.floor(0.95 * F.col("n")).cast("long"))
    return rows.join(F.broadcast(at), ["event_type"]).where(F.col("pos") == F.col("at")).select("event_type", "mean", F.col("value").alias("p95"))


QUERIES = {f.__name__: f for f in (tm_search, tm_list, pending_segments, linear_order, bench_latency)}

_INNER = "[^\\p{L}\\p{N}_]"
_HOLDS = f"CASE WHEN contains(lower({{0}}), lower({{1}})) THEN regexp_matches(lower({{0}}), concat('(^|{_INNER})\\Q', lower({{1}}), '\\E($|{_INNER})')) ELSE false END"


def _holds(a: str, b: str) -> str:
    return _HOLDS.replace("{0}", a).replace("{1}", b)


ORACLES = {
    "tm_search": f"WITH {LINES_SQL}, {TM_SQL} SELECT doc_id, line_no, tm_id, CASE WHEN lower(trim(line)) = lower(trim(source_term)) THEN 'exact' ELSE 'partial' END AS kind FROM lines, tm WHERE confidence >= {LEAST_CONFIDENCE} AND trim(line) <> '' AND ({_holds('line', 'source_term')} OR {_holds('source_term', 'line')})",
    "tm_list": f"WITH {TM_SQL} SELECT tm_id, occurrences, row_number() OVER (ORDER BY occurrences DESC, tm_id) AS pos FROM tm",
    "pending_segments": f"WITH {PAIRS_SQL} SELECT doc_id, chapter, seq, row_number() OVER (ORDER BY chapter, seq) AS pos FROM pairs WHERE doc_id % 4 IN (0, 1)",
    "linear_order": f"WITH {LINES_SQL} SELECT doc_id, line_no, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) AS pos FROM lines",
    "bench_latency": "SELECT event_type, round(avg(value), 6) AS mean, list(value ORDER BY value, event_id)[CAST(floor(0.95e0 * count(*)) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type",
}
