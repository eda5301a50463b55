from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.sources import database


def test_a_table_is_read_by_ranges_of_its_key(spark):
    """An embedded database in memory."""
    url, driver = "jdbc:derby:memory:tenders;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(1000).select(F.when(F.col("id") != 7, F.col("id")).alias("ID"), (F.col("id") % 5).cast("int").alias("KIND"), F.concat(F.lit("t"), "id").alias("TITLE"))
    database.write(rows, url, "AOS", driver)
    found = database.read(spark, url, "AOS", "ID", driver, rows_each=150)
    assert found.rdd.getNumPartitions() == 7 and sorted(r["TITLE"] for r in found.collect()) == sorted(r["TITLE"] for r in rows.collect())
    wanted = found.filter("KIND = 3").select("TITLE")
    assert "PushedFilters" in (plan := wanted._jdf.queryExecution().executedPlan().toString()) and "KIND = 3" in plan.replace("EqualTo(KIND,3)", "KIND = 3") and wanted.count() == 200
    assert database.read(spark, url, "(SELECT * FROM AOS WHERE KIND = 9) x", "ID", driver).count() == 0
