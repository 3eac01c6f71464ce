"""Upserts on tables of plain files: the new state as a DataFrame, written to a new place by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.common import first_by


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The table after the updates: of each key the last update by `order`; columns in `keep` stay as they first were.

    A key's first value of a kept column is the table's, else that of the key's first update."""
    last = first_by(updates, keys, F.desc(order))
    own = [c for c in table.columns if c not in keys]
    firsts = first_by(updates, keys, F.asc(order)).select(*keys, *(F.col(c).alias(f"_first_{c}") for c in keep))
    new = last.join(firsts, keys).select(*keys, *(F.col(f"_first_{c}" if c in keep else c).alias(f"_new_{c}") for c in own), F.lit(True).alias("_updated"))
    out = table.withColumn("_there", F.lit(True)).join(new, keys, "full")
    value = lambda c: F.when(F.col("_updated").isNull() | (F.col("_there").isNotNull() & F.lit(c in keep)), F.col(c)).otherwise(F.col(f"_new_{c}"))
    return out.select(*keys, *(value(c).alias(c) for c in own)).select(*table.columns)


def replace_group(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the keys that `rows` names replaced by those."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(*table.columns)).select(*table.columns)


def delete_group(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)
