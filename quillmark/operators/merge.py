"""Keyed merges of tables that have no transactional format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of updates replace rows of base with the same key; columns that one side lacks are null. Updates have a key once."""
    return base.join(updates.select(key), key, "left_anti").unionByName(updates, allowMissingColumns=True)


def update(base: DataFrame, changed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Some columns of base from the rows of changed with the same key; a row without a match stays."""
    side = changed.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = base.join(side, base[key] == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    return joined.select(*(F.when(hit, F.col(f"_new_{c}")).otherwise(base[c]).alias(c) if c in columns else base[c] for c in base.columns))


def cancel(base: DataFrame, ids: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows whose key is in ids are marked as cancelled."""
    side = ids.select(F.col(key).alias("_key")).distinct()
    hit = F.col("_key").isNotNull()
    return base.join(side, base[key] == F.col("_key"), "left").withColumns({"etat": F.when(hit, "AVIS_ANNULE").otherwise(F.col("etat")), "status": F.when(hit, "cancelled").otherwise(F.col("status"))}).drop("_key")


def delete(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def insert_new(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Appends the rows whose key is not there."""
    return base.unionByName(rows.join(base.select(*key), key, "left_anti"), allowMissingColumns=True)


def violations(rows: DataFrame, unique: list[str] = (), checks: dict[str, Column] | None = None) -> DataFrame:
    """(rule, n): how many keys occur twice in a column, and how many rows fail a check; rules that hold have 0."""
    parts = [rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit(f"unique {c}").alias("rule"), "n") for c in unique]
    parts += [rows.agg(F.count_if(~F.coalesce(c, F.lit(True))).alias("n")).select(F.lit(name).alias("rule"), "n") for name, c in (checks or {}).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def array_sizes(rows: DataFrame, column: str) -> DataFrame:
    """(size, n): how many rows have an array of each size; null arrays have none."""
    return rows.groupBy(F.when(F.col(column).isNotNull(), F.size(column)).alias("size")).agg(F.count(F.lit(1)).alias("n"))
