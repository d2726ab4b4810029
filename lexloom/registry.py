"""All queries of the engine's own operators, with their DuckDB equivalents.

A module of lexloom.plans has QUERIES (name -> callable of (spark, sf_dir)) and ORACLES (name -> SQL).
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("terms", "qa", "story", "text", "translate", "files", "misc", "semantic", "context", "consistency", "memory", "style", "analysis", "pages", "runtime", "relations")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query."""
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"lexloom.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    """The SQL of those that DuckDB can run."""
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"lexloom.plans.{name}").ORACLES
    return found
