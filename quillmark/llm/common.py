"""What the corpus operators share: reading tables, cutting lineage, sizing buckets."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of input for which one bucket of a blob shuffle is planned; a bucket is what one task holds at once.
BYTES_PER_BUCKET = 8 << 20
MIN_BUCKET_BITS, MAX_BUCKET_BITS = 6, 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame, parts: int | None = None) -> DataFrame:
    """The same rows, computed once and kept in the folder that all executors share; in at most so many parts.

    The folder is the one that the session names in ``spark.checkpoint.dir``. Only where that is unset and all tasks run in
    the driver's process (as in tests) a temporary one is made; on a cluster it is an error, as executors would not see it.
    The shuffle files that made the rows are given back at once: nothing reads them again.
    """
    if parts is not None:
        df = df.coalesce(parts)
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    kept = df.checkpoint(eager=True)
    _give_back(df)
    return kept


def unestimated(kept: DataFrame) -> DataFrame:
    """The rows of a checkpoint, read as an RDD whose size the optimiser does not know; ``discard`` takes the checkpoint itself.

    A checkpoint inherits the estimate of its plan, and that of a join is the product of its sides. Where each round joins what the round
    before has kept, the digits of this number multiply from round to round, and a few dozen copies of it fill the driver.
    """
    spark = kept.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)


def parts_for(spark: SparkSession, rows: int, each: int) -> int:
    """How many parts a result of at most so many rows is kept in: no more small files than its size asks for, but work for every core."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // each))


def _give_back(df: DataFrame) -> None:
    """Removes the shuffle files of a DataFrame's own execution. What is still read elsewhere is part of other executions."""
    cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
    if cleaner.isEmpty():
        return
    todo, seen, shuffles = [df._jdf.queryExecution().toRdd()], set(), set()
    while todo:
        rdd = todo.pop()
        if rdd.id() in seen:
            continue
        seen.add(rdd.id())
        found = rdd.dependencies()
        for k in range(found.length()):
            dependency = found.apply(k)
            if dependency.getClass().getSimpleName() == "ShuffleDependency":
                shuffles.add(dependency.shuffleId())
            todo.append(dependency.rdd())
    for k in sorted(shuffles):
        cleaner.get().doCleanupShuffle(k, True)


def discard(*kept: DataFrame) -> None:
    """Deletes checkpoints, by reference, that nothing reads any more: what was made from them must be checkpointed itself."""
    for df in kept:
        cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
        if not cleaner.isEmpty():
            cleaner.get().doCleanCheckpoint(df._jdf.queryExecution().logical().rdd().id())


def stable(df: DataFrame) -> DataFrame:
    """Rows whose order stays when a lost task is run again: those of a table or a checkpoint as they are; behind a shuffle, checkpointed."""
    return checkpointed(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def input_bytes(df: DataFrame) -> int:
    """Bytes of what the plan reads, as the optimiser knows them; without statistics a count of rows stands in."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.count() * 4096


def chunk_bytes(df: DataFrame, base: int) -> int:
    """Text that one chunk packs together: more for a larger input, so that a chunk's share of each of more buckets does not become tiny."""
    size, wide = input_bytes(df), base
    while size > 256 << 30 and wide < 8 * base:
        size, wide = size // 4, wide * 2
    return wide


def bucket_bits(df: DataFrame) -> int:
    """log2 of the number of buckets, so that a bucket's share of the input has about the same size at every scale."""
    wanted = max(1, input_bytes(df) // BYTES_PER_BUCKET)
    return min(MAX_BUCKET_BITS, max(MIN_BUCKET_BITS, int(wanted - 1).bit_length()))


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system: workers wait for their next task, and their idle memory adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that trims its worker at the end of the task."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return inner
