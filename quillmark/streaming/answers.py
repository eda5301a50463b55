"""Answers to mails, as they arrive as files of signed events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.links import verify

S = T.StringType()
EVENT = T.StructType([T.StructField("source_id", S), T.StructField("token", S), T.StructField("feedback", S), T.StructField("client_id", S), T.StructField("at", T.TimestampType())])


def read(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """One JSON object a line; broken lines are dropped."""
    return spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files).json(folder)


def signed(events: DataFrame, secret: str) -> DataFrame:
    """The events whose token belongs to their source_id and whose feedback is not blank, as drafts of corrections."""

    @F.pandas_udf("boolean")
    def good(subjects: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([s is not None and t is not None and verify(s, t, secret) for s, t in zip(subjects, tokens, strict=True)])

    kept = events.filter((F.trim(F.coalesce("feedback", F.lit(""))) != "") & good("source_id", "token"))
    return kept.select("source_id", "client_id", F.trim("feedback").alias("feedback"), F.lit("draft").alias("status"), F.lit("email").alias("source"), F.col("at").alias("created_at"))
