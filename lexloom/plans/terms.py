"""Term statistics over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.session import table

# The stop words that term statistics leave out.
STOPWORDS = ("the", "and", "for", "that", "was", "with", "are", "que", "les", "des", "une", "pour", "der", "die", "das", "und", "von", "mit", "los", "las", "por", "para")


def term_frequency_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent terms of three letters or more of each language; ties by term."""
    terms = (
        table(spark, sf_dir, "documents")
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{3,})"), 1)).alias("term"))
        .where(~F.col("term").isin(*STOPWORDS))
    )
    counts = terms.groupBy("lang", "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).where("rank <= 20").select("lang", "term", "n", "rank")


QUERIES = {"term_frequency_top20": term_frequency_top20}
ORACLES = {
    "term_frequency_top20": f"""
WITH terms AS (
  SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{{L}}]{{3,}}')) AS term FROM documents),
counts AS (
  SELECT lang, term, count(*) AS n FROM terms WHERE term NOT IN {STOPWORDS} GROUP BY lang, term)
SELECT lang, term, n, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS INTEGER) AS rank FROM counts) WHERE rank <= 20
""",
}
