"""Table functions, for SQL and DataFrames: ``FROM pack_rows(TABLE(t) PARTITION BY key ORDER BY (ord), 500)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="key string, chunk int, first_ord long, last_ord long, n_rows int, content string", useArrow=True)
class PackRows:
    """Consecutive rows (key, ord, text) of a key as chunks of at most ``most`` characters, joined by line breaks.

    A row that is longer stands alone; a null text is empty. One chunk is held at a time, whatever the length of the partition.
    """

    def __init__(self) -> None:
        self.key: str | None = None
        self.chunk, self.first, self.last, self.size = 0, None, None, 0
        self.texts: list[str] = []

    def _said(self) -> tuple:
        return self.key, self.chunk, self.first, self.last, len(self.texts), "\n".join(self.texts)

    def eval(self, row: Row, most: int) -> Iterator[tuple]:
        text = row["text"] or ""
        if self.texts and self.size + 1 + len(text) > most:
            yield self._said()
            self.chunk, self.texts, self.size = self.chunk + 1, [], 0
        self.key = row["key"]
        self.size += len(text) + bool(self.texts)
        self.first = self.first if self.texts else row["ord"]
        self.last = row["ord"]
        self.texts.append(text)

    def terminate(self) -> Iterator[tuple]:
        if self.texts:
            yield self._said()


def register(spark: SparkSession) -> None:
    """Table functions under their names in SQL."""
    spark.udtf.register("pack_rows", PackRows)


def pack_rows(rows: DataFrame, most: int, *ties: str) -> DataFrame:
    """The chunks of rows (key string, ord long, text string, and columns that decide between equal ord)."""
    return PackRows(rows.asTable().partitionBy("key").orderBy("ord", *ties), F.lit(most))
