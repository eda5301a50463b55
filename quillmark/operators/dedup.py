"""Matching of tenders across platforms and against what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Strategies in order of priority: (name, key of the new row, key of the stored row).
STRATEGIES = (("notice_number", "notice_number", "source_id"), ("uuid", "uuid_key", "uuid_key"), ("composite", "composite_key", "composite_key"), ("siret_deadline", "siret_deadline_key", "siret_deadline_key"))


def index(stored: DataFrame, key: str, identity: str = "id") -> DataFrame:
    """(key, id): one stored row for each key, the last by id. Partial sums come before the shuffle, so a hot key is no hot group."""
    return stored.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(identity).alias("_id"))


def match(new: DataFrame, stored: DataFrame, strategies: tuple = STRATEGIES, identity: str = "id") -> DataFrame:
    """Adds matched_id and match_strategy: the first strategy in order that finds a stored row; both null without any.

    Each strategy is an equi-join with a table of distinct keys, so rows of ``new`` are never multiplied. Stored rows are those
    that count as analysed; the caller filters them.
    """
    out, found = new, []
    for k, (name, own, other) in enumerate(strategies):
        side = index(stored, other, identity).select(F.col("_key").alias(f"_key{k}"), F.col("_id").alias(f"_id{k}"))
        out = out.join(side, out[own] == side[f"_key{k}"], "left").drop(f"_key{k}")
        found.append((name, F.col(f"_id{k}")))
    chosen = {"matched_id": F.coalesce(*(c for _, c in found)), "match_strategy": F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in found))}
    return out.withColumns(chosen).drop(*(f"_id{k}" for k in range(len(strategies))))


def unmatched(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("matched_id").isNull())


def strategy_counts(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("match_strategy").isNotNull()).groupBy("match_strategy").agg(F.count(F.lit(1)).alias("n"))


def already_analysed(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds known: is the row stored as analysed, by (source, source_id) or else by uuid?"""
    done = stored.filter(F.col("status") == "analyzed")
    by_id = done.select(F.col("source").alias("_s"), F.col("source_id").alias("_i")).distinct()
    by_uuid = done.filter(F.col("uuid_procedure").isNotNull()).select(F.col("uuid_procedure").alias("_u")).distinct()
    joined = new.join(by_id, (new["source"] == F.col("_s")) & (new["source_id"] == F.col("_i")), "left").join(by_uuid, new["uuid_procedure"] == F.col("_u"), "left")
    return joined.withColumn("known", F.col("_i").isNotNull() | F.col("_u").isNotNull()).drop("_s", "_i", "_u")


def to_analyse(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that are not known, and substantial amendments even if they are."""
    return already_analysed(new, stored).filter(~F.col("known") | F.coalesce(F.col("is_substantial"), F.lit(False))).drop("known")


def drop_repeats(tenders: DataFrame) -> DataFrame:
    """One row for each source_id within a run."""
    return tenders.dropDuplicates(["source_id"])


def latest(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group under an order, which should end in a unique column."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")
