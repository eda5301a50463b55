"""Sources that are files: corpora, documents, queues, fixtures; and inline relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: T.StructType = schemas.CORPUS_CHUNK) -> DataFrame:
    """One JSON object a line; blank and broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def broken_lines(spark: SparkSession, path: str, schema: T.StructType = schemas.CORPUS_CHUNK) -> DataFrame:
    """The lines that ``jsonl`` drops, for a warning."""
    kept = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).filter(F.trim("value") != "").select(parsed["_bad"].alias("_bad")).filter(F.col("_bad").isNotNull())


def _present(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def reference_clients(spark: SparkSession, path: str) -> DataFrame:
    """Known clients of a JSON document, in order; a missing document has none."""
    doc = spark.read.schema(schemas.REFERENCE_CLIENTS).option("multiLine", True).json(path) if _present(spark, path) else spark.createDataFrame([], schemas.REFERENCE_CLIENTS)
    return doc.select(F.posexplode("clients").alias("ord", "client")).select("ord", "client.*").orderBy("ord")


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of a JSON array; a label may be a boolean or a word."""
    return spark.read.schema(schemas.EVAL_CASE).option("multiLine", True).json(path)


def retry_queue(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of {"jobs": [...]} or of a plain array, the older layout; missing, empty and broken files give no jobs."""
    if not _present(spark, path):
        if not _present(spark, f"{path}.old"):
            return spark.createDataFrame([], schemas.RETRY_JOB)
        path = f"{path}.old"  # a change of layout was cut off
    text = spark.read.text(path, wholetext=True)
    many = schemas.T.ArrayType(schemas.RETRY_JOB)
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", many)).otherwise(F.from_json("value", schemas.struct(jobs=many))["jobs"])
    return text.select(F.explode(listed).alias("job")).select("job.*").filter(F.col("id").isNotNull())


def write_queue(queue: DataFrame, path: str) -> None:
    """As one {"jobs": [...]} in a file that takes the place of ``path`` in one step once it is written, so the queue may be read from there.

    The queue is a short list (a job for each client and day that failed), so it may be one row. Whenever a run is cut off, ``path`` holds the
    old queue or the new one: the last step is a rename over it, which file systems of Hadoop make as one. A folder of an older version is
    moved aside first, and is read until the new file is there.
    """
    spark = queue.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    jobs = F.array_sort(F.collect_list(F.struct(*(F.col(f.name) for f in schemas.RETRY_JOB.fields))))
    queue.agg(F.to_json(F.struct(jobs.alias("jobs")), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}.new")
    place, fresh, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    files = place.getFileSystem(conf)
    written = [f.getPath() for f in files.listStatus(fresh) if f.getPath().getName().startswith("part-")]
    if files.exists(place) and files.getFileStatus(place).isDirectory():
        files.delete(aside, True)
        files.rename(place, aside)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(written[0]), files.makeQualified(place), over)
    files.delete(fresh, True)
    files.delete(aside, True)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant relation, such as regions by department or labels of categories."""
    return spark.createDataFrame(rows, schema)


def rewrite(chunks: DataFrame, replacements: DataFrame) -> DataFrame:
    """Chunks whose id has replacements (id, parts: array of chunks) become these; the others pass."""
    r = replacements.select(F.col("id").alias("_id"), "parts")
    joined = chunks.join(r, chunks["id"] == F.col("_id"), "left")
    own = F.array(F.struct(*(F.col(c) for c in chunks.columns)))
    return joined.select(F.explode(F.coalesce(F.col("parts").cast(T.ArrayType(chunks.schema)), own)).alias("c")).select("c.*")
