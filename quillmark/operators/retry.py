"""The queue of days to be read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import temporal


def schedule(queue: DataFrame, wanted: DataFrame, at: str, minutes: int = 60) -> DataFrame:
    """The queue and the new jobs (clientId, date, reason) that no pending one covers; dates must be days."""
    valid = wanted.filter(F.col("clientId").isNotNull() & F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$")).dropDuplicates(["clientId", "date"])
    pending = queue.filter("status = 'pending'").select("clientId", "date")
    due = F.date_format(F.lit(at).cast("timestamp") + F.expr(f"INTERVAL {int(minutes)} MINUTES"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    new = valid.join(pending, ["clientId", "date"], "left_anti").select(
        F.concat_ws("-", F.lit("retry"), "clientId", "date").alias("id"), "clientId", "date", due.alias("executeAt"), F.lit(minutes).alias("delayMinutes"), "reason",
        F.lit("pending").alias("status"), F.lit(at).alias("createdAt"), F.lit(None).cast("string").alias("completedAt"), F.lit(None).cast("string").alias("error"),
    )
    return queue.unionByName(new)


def ready(queue: DataFrame, at: str) -> DataFrame:
    return queue.filter((F.col("status") == "pending") & (temporal.instant(F.col("executeAt")) <= F.lit(at).cast("timestamp")))


def has_pending(queue: DataFrame, client_id: str, day: str) -> bool:
    return queue.filter((F.col("clientId") == client_id) & (F.col("date") == day) & (F.col("status") == "pending")).limit(1).count() > 0


def settle(queue: DataFrame, outcomes: DataFrame, at: str) -> DataFrame:
    """Jobs with an outcome (id, error) are completed, or failed where there is an error."""
    o = outcomes.select(F.col("id").alias("_id"), F.col("error").alias("_error"))
    hit = F.col("_id").isNotNull()
    done = F.when(F.col("_error").isNull(), "completed").otherwise("failed")
    joined = queue.join(o, queue["id"] == F.col("_id"), "left")
    return joined.withColumns({"status": F.when(hit, done).otherwise(F.col("status")), "completedAt": F.when(hit, F.lit(at)).otherwise(F.col("completedAt")), "error": F.when(hit, F.col("_error")).otherwise(F.col("error"))}).drop("_id", "_error")


def retain(queue: DataFrame, at: str, days: int = 30) -> DataFrame:
    """Pending jobs, and others of the last days."""
    return queue.filter((F.col("status") == "pending") | (temporal.instant(F.col("createdAt")) >= F.lit(at).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")))
