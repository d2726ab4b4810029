"""Queries of loops in a model's texts, of machines and of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import loops, runtime
from lexloom.plans.fixtures import values
from lexloom.session import table

#: What a model might put in front of a text.
LOOP = "model_input = the house - x\nThe house\nA line.\nA line.\nEcho\necho\nECHO\nHe came. He came. He left.\n\n\n\nas he said that as he said that he went\n"
VERSIONS = [(k, f"step {k}") for k in range(1, 10)]
APPLIED = [(1,), (2,), (4,), (None,)]


def clean_repetition_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, behind a model's loops, cleaned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(LOOP), "text").alias("text"))
    return loops.clean(docs).select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("h"))


def hardware_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of machines whose sizes are taken from the suppliers' rows."""
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", (F.pmod("s_suppkey", F.lit(40)) / 2).alias("ram_gb"), (F.pmod("s_suppkey", F.lit(3)) > 0).alias("gpu"),
        (F.pmod("s_suppkey", F.lit(25)) / 2).alias("vram_gb"), F.pmod("s_suppkey", F.lit(11)).cast("double").alias("disk_gb"))
    return runtime.hardware_profile(rows).select("s_suppkey", "profile", "suitable", F.array_join("warnings", "|").alias("warnings"))


def migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions not applied yet, in order."""
    return runtime.pending_versions(spark.createDataFrame(VERSIONS, "version int, name string"), spark.createDataFrame(APPLIED, "version int"))


QUERIES = {f.__name__: f for f in (clean_repetition_loops, hardware_rule, migrations)}
ORACLES = {
    "hardware_rule": """SELECT s_suppkey, CASE WHEN gpu AND vram >= 10 THEN 'quality' WHEN gpu AND vram >= 5.5 THEN 'balanced' WHEN ram >= 15 THEN 'balanced' ELSE 'economy' END AS profile, (gpu AND vram >= 5.5) OR ram >= 7.5 AS suitable,
  concat_ws('|', CASE WHEN disk < 5 THEN 'disk' END, CASE WHEN gpu AND vram < 5.5 THEN 'gpu memory' END, CASE WHEN NOT (gpu AND vram >= 5.5) AND ram >= 7.5 AND ram < 15 THEN 'economy only' END, CASE WHEN NOT (gpu AND vram >= 5.5) AND ram < 7.5 THEN 'memory' END) AS warnings
  FROM (SELECT s_suppkey, s_suppkey % 40 / 2 AS ram, s_suppkey % 3 > 0 AS gpu, s_suppkey % 25 / 2 AS vram, s_suppkey % 11 AS disk FROM supplier)""",
    "migrations": f"SELECT k.version, k.name FROM {values(VERSIONS, 'version, name')} k WHERE NOT EXISTS (SELECT 1 FROM {values(APPLIED, 'version')} a WHERE a.version = k.version)",
}
