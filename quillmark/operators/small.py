"""Small tables that are sent to all tasks: their size is checked, never cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table of names, such as regions or prices, and what they take as text.
MAX_ROWS, MAX_BYTES = 10_000, 32 << 20


def small(rows: DataFrame, what: str, most: int = MAX_ROWS) -> DataFrame:
    """The rows with a hint to send them to all tasks; an error if there are more than ``most``, or if they are too long."""
    n, size = rows.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    if n > most:
        raise ValueError(f"{what} has more than {most} rows")
    if size > MAX_BYTES:
        raise ValueError(f"{what} has more than {MAX_BYTES} bytes")
    return F.broadcast(rows)
