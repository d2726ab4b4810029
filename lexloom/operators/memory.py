"""Editorial memories as tables: changes that respect locks, what each changed, and who changed what when.

A memory has keys, values, a `locked` flag and, it may be, arrays that only grow (aliases, evidence). Nothing is changed in
place: an upsert gives the new table and an audit of its differences, both by one full join on the keys.

Cases: a null value is a value; null keys never meet; of several incoming rows of a key the last by `order` counts; a memory
or change without rows is a table without rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ADDED, UPDATED, UNCHANGED, REJECTED, KEPT = "added", "updated", "unchanged", "rejected", "kept"


def latest(rows: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The last row of each key in this order. A partial maximum, so a frequent key is no task's load."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def upsert(memory: DataFrame, incoming: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], growing: tuple[str, ...] = (), force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(memory after the change, outcomes). Both tables have the keys, values, growing arrays and `locked`.

    A locked entry whose values would change is refused unless forced; growing arrays are united in any case; an entry stays
    locked once it is. outcomes: (keys, outcome) of every incoming key.
    """
    old = memory.select(*keys, F.struct("locked", *values, *growing).alias("_old"))
    new = incoming.select(*keys, F.struct("locked", *values, *growing).alias("_new"))
    both = old.join(new, list(keys), "full")
    o, n = F.col("_old"), F.col("_new")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~o[v].eqNullSafe(n[v])
    refused = differs & F.coalesce(o["locked"], F.lit(False)) & F.lit(not force)
    outcome = F.when(n.isNull(), KEPT).when(o.isNull(), ADDED).when(refused, REJECTED).when(differs, UPDATED).otherwise(UNCHANGED)
    both = both.withColumn("outcome", outcome)
    take = F.col("outcome").isin(ADDED, UPDATED)
    columns = [F.when(take, n[v]).otherwise(o[v]).alias(v) for v in values]
    columns += [F.array_sort(F.array_distinct(F.concat(F.coalesce(o[g], F.array()), F.coalesce(n[g], F.array())))).alias(g) for g in growing]
    locked = F.coalesce(o["locked"], F.lit(False)) | (F.coalesce(n["locked"], F.lit(False)) & (F.col("outcome") != REJECTED))
    after = both.select(*keys, *columns, locked.alias("locked"))
    return after, both.where(n.isNotNull()).select(*keys, "outcome")


def differences(before: DataFrame, after: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """An audit: (keys, field, old_value, new_value) of each value that differs; entries that are only on one side are left out."""
    a = before.select(*keys, *[F.col(v).cast("string").alias(f"_a_{v}") for v in values])
    b = after.select(*keys, *[F.col(v).cast("string").alias(f"_b_{v}") for v in values])
    fields = F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"_a_{v}").alias("old_value"), F.col(f"_b_{v}").alias("new_value")) for v in values])
    changed = F.filter(fields, lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))
    return a.join(b, list(keys)).select(*keys, F.explode(changed).alias("x")).select(*keys, "x.field", "x.old_value", "x.new_value")


def history(audit: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """audit with `pos`, the newest change of each entry first."""
    return audit.withColumn("pos", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def lock(memory: DataFrame, condition: Column, locked: bool = True) -> DataFrame:
    """memory with the entries that meet a condition locked, or unlocked."""
    return memory.withColumn("locked", F.when(F.coalesce(condition, F.lit(False)), F.lit(locked)).otherwise(F.col("locked")))


def alias_conflicts(entries: DataFrame, key: str, name: str, aliases: str = "aliases") -> DataFrame:
    """(alias, key, other): aliases that are another entry's name, in either case."""
    words = entries.select(key, F.explode(aliases).alias("alias")).withColumn("low", F.lower("alias"))
    names = entries.select(F.col(key).alias("other"), F.lower(name).alias("low"))
    return words.join(names, "low").where(F.col(key) != F.col("other")).select("alias", key, "other")
