"""The registered queries of this subpackage: opN_<name>, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import chat, decontaminate, language, media, ngram_join, oracles, packing, pii, secrets, toxicity, warc
from lexloom.session import materialise, table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, read back from their prefix trees."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    trees, _ = materialise(chat.format_trees(rows.unionByName(own)), "trees")
    return chat.read_trees(trees).drop("n_tokens")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed in sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an MPEG audio stream, read back."""
    out = media.encode_media(table(spark, sf_dir, "documents"), keep_media=False)
    return out.drop("media")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels are learned where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = toxicity.crc_mod("doc_id", 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; profiles are learned where crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = toxicity.crc_mod("doc_id", 4) == 2
    profiles = language.train(docs, ~held_out)
    return language.identify(docs.drop("lang"), profiles).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find_pii(docs, pii.train(docs))).drop("text")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged against the whole benchmark."""
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judge(hits).drop("text")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 3/4 of their five-word shingles."""
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to archives and read back by byte ranges."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All of them by name."""
    return {f.__name__: f for f in (op1_chat, op2_packing, op3_media, op4_toxicity, op5_language, op6_pii, op7_decontaminate, op8_ngram_join, op9_secrets, op10_warc)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL expresses."""
    return {"op1_chat": oracles.CHAT, "op7_decontaminate": oracles.DECONTAMINATE, "op8_ngram_join": oracles.NGRAM_JOIN, "op10_warc": oracles.WARC}
