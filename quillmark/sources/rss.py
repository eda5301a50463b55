"""RSS files as items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark import schemas

_XML = T.StructType([T.StructField({"date": "dc:date", "dateAccepted": "dc:dateAccepted", "Location": "dc:Location", "creator": "dc:creator"}.get(f.name, f.name), f.dataType) for f in schemas.RSS_ITEM.fields])


def items(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The items of all feeds; a feed that cannot be parsed has none. Names lose their prefixes."""
    raw = spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema(_XML).load(paths)
    return raw.select(*(F.col(f"`{x.name}`").alias(y.name) for x, y in zip(_XML.fields, schemas.RSS_ITEM.fields, strict=True)))
