from __future__ import annotations

import glob

from helpers import documents

from quillmark.llm import common


def test_discarded_checkpoints_leave_the_folder(spark):
    one = common.checkpointed(spark.range(100).selectExpr("id % 7 k").groupBy("k").count())
    two = common.checkpointed(one.selectExpr("k", "count * 2 n"))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    number = lambda df: df._jdf.queryExecution().logical().rdd().id()
    assert glob.glob(f"{folder}/rdd-{number(one)}") and glob.glob(f"{folder}/rdd-{number(two)}")
    common.discard(one)
    assert not glob.glob(f"{folder}/rdd-{number(one)}") and glob.glob(f"{folder}/rdd-{number(two)}")
    assert two.agg({"n": "sum"}).first()[0] == 200


def test_rows_behind_a_shuffle_are_checkpointed(spark):
    docs = documents(spark, [(1, "a"), (2, "b")])
    assert common.stable(docs.filter("doc_id > 0")).count() == 2
    moved = common.stable(docs.repartition(3, "doc_id"))
    assert "Exchange" not in moved._jdf.queryExecution().executedPlan().toString() and moved.count() == 2
    assert common.stable(moved) is moved
