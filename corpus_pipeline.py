"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet before
the next one reads it. All but the last return the columns of documents.

1. toxicity: documents predicted toxic go. The classifier learns from labelled rows of its own input.
2. ngram_jaccard: of each group of near copies (five-word shingles, 3/4) the document with the smallest id stays.
3. decontaminate: documents of which 1 word in 20 or more lies in a benchmark window go.
4. secrets: secrets in texts are replaced by a mark, and n_chars follows; no document goes.
5. pack: the texts as token sequences of at most 4096, as few as best fit makes.

Columns beyond those of documents pass through stages 1 to 4; nulls in any column do not drop a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, ngram_join, packing, secrets, toxicity
from lexloom.session import materialise, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.crc_mod("doc_id", 3) != 1)
    return toxicity.reject(docs, model)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their secrets."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("pack", packing_stage),
]

#: The classifier's scores and the tokenizer's ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
