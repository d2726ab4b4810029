"""Rows that keep all their columns, whatever these are called, while an operator works on the text beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carried(docs: DataFrame, text_col: str = "text", *more: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """((row, text, *more) of docs, and what makes docs of such rows again).

    `row` is a struct of all columns but the text, so no name in it can clash with one that an operator adds.
    """
    names = docs.columns
    others = [c for c in names if c != text_col]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)], F.lit(0).alias("none"))
    out = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"key{k}") for k, c in enumerate(more)])

    def back(rows: DataFrame) -> DataFrame:
        place = {c: k for k, c in enumerate(others)}
        return rows.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.c{place[c]}").alias(c) for c in names])

    return out, back
