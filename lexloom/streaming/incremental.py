"""Incremental runs: a stream of new segments, a cache of finished ones, and only misses reach the model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key(text: str = "source", model: str = "model", context: str = "") -> F.Column:
    """Key of a segment's result."""
    return F.sha2(F.concat_ws("|", F.col(text), F.lit(model), F.lit(context)), 256)


def run_incremental(spark: SparkSession, source: str, cache: str, checkpoint: str, schema: str, model: Callable[[DataFrame], DataFrame]) -> int:
    """Takes the files under source that no earlier run took, and appends what the cache lacks; rows appended.

    model maps rows with `source` to rows with `target`. The checkpoint replaces a table of progress; a batch that was cut
    off is repeated, and its keys that are in the cache already are left out.
    """
    done: list[int] = []

    def take(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("cache_key", cache_key()).dropDuplicates(["cache_key"])
        try:
            known = spark.read.parquet(cache).select("cache_key")
            rows = rows.join(known, "cache_key", "left_anti")
        except Exception as e:  # the first run has no cache yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        before = done[-1] if done else 0
        model(rows).write.mode("append").parquet(cache)
        done.append(before + 1)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: an extension for event streams, with a watermark for late rows."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "n", "value")
