from __future__ import annotations

from quillmark.functions import tables


def test_pack_rows(spark):
    rows = [("a", 3, "cc"), ("a", 1, "aa"), ("a", 2, None), ("b", 1, "x" * 9), ("b", 2, "y"), (None, 1, "n")]
    frame = spark.createDataFrame(rows, "key string, ord long, text string")
    want = {("a", 0, 1, 2, 2, "aa\n"), ("a", 1, 3, 3, 1, "cc"), ("b", 0, 1, 1, 1, "x" * 9), ("b", 1, 2, 2, 1, "y"), (None, 0, 1, 1, 1, "n")}
    assert set(map(tuple, tables.pack_rows(frame, 4).collect())) == want
    tables.register(spark)
    frame.createOrReplaceTempView("pack_rows_input")
    assert set(map(tuple, spark.sql("SELECT * FROM pack_rows(TABLE(pack_rows_input) PARTITION BY key ORDER BY (ord), 4)").collect())) == want
    assert tables.pack_rows(frame.limit(0), 4).count() == 0
