"""Tables of a database over JDBC: read in ranges of a key, one query for each partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that one partition is planned for.
ROWS = 100_000


def read(spark: SparkSession, url: str, table: str, key: str, properties: dict[str, str] | None = None, rows_each: int = ROWS) -> DataFrame:
    """The rows of a table (or of a query in parentheses with a name), in ranges of a whole-number key.

    One small query asks for the ends of the key and the number of rows; filters and columns that are used are pushed to the database. Rows
    without a key are read too, with the first range. An empty table is one empty partition.
    """
    options = {"url": url, **(properties or {})}
    ask = spark.read.format("jdbc").options(**options).option("query", f"SELECT MIN({key}) AS low_key, MAX({key}) AS high_key, COUNT(*) AS all_rows FROM {table}").load().first()
    low, high, n = ask[0], ask[1], int(ask[2])
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    parts = max(1, -(-n // rows_each))
    if low is None or parts == 1 or low == high:
        return reader.load()
    return reader.option("partitionColumn", key).option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", parts).load()


def write(rows: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, parts: int = 8) -> None:
    """Appends rows over a bounded number of connections."""
    rows.coalesce(parts).write.format("jdbc").options(url=url, dbtable=table, **(properties or {})).mode("append").save()
