"""Replay-safe ingestion: bounded micro-batches into keyed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillmark.operators import merge
from quillmark.sources.buckets import BucketTable


def read(spark: SparkSession, folder: str, schema: T.StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def deduplicated(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """First row of each key within the watermark; state leaves as the watermark passes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, by: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window and column."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("window"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def upsert_into(stream: DataFrame, folder: str, key: str, checkpoint: str, order: str) -> StreamingQuery:
    """Merges each micro-batch into the versions of a keyed table: ``folder/v=<batch>``; the last row of a key counts.

    A batch that is replayed writes its own version again from the one before, so a restart changes nothing. Only these two
    versions are kept. A batch rewrites the table, as plain files have no other way; one that is read while it is
    written should be a table format of its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in batch.columns)), order).alias("r")).select("r.*")
        if number:
            last = merge.upsert(spark.read.parquet(f"{folder}/v={number - 1}"), last, key)
        last.write.mode("overwrite").parquet(f"{folder}/v={number}")
        if number > 1:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_buckets(stream: DataFrame, table: BucketTable, checkpoint: str, order: str, once: bool = True) -> StreamingQuery:
    """Merges each micro-batch into a table of buckets: a batch is a commit of its number, and rewrites the buckets of its keys only.

    A batch that is replayed finds its commit and changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        table.merge(batch, number, order)

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def run_daily(stream: DataFrame, step: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """What has arrived since the last run goes through a step and is appended; each batch is written once."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
