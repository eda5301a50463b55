from __future__ import annotations

import random

import numpy as np
import pytest

from quillmark.operators import retrieval, vectors

INDEX, QUERIES = "id long, vector array<float>", "query_id long, query array<float>"


def clustered(n: int, seed: int, spread: float = 0.1) -> list[list[float]]:
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    return [[x + r.gauss(0, spread) for x in r.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("spread, cells, block", [(0.05, 8, 1024), (2.0, 20, 16)])
def test_equals_comparing_all(spark, spread, cells, block):
    """Clustered and shapeless vectors, equal ones, and some without a cosine."""
    rows = clustered(400, 1, spread)
    rows[50] = rows[60] = rows[70]
    index = spark.createDataFrame([*enumerate(rows), (900, None), (901, [0.0] * 6), (902, [1.0])], INDEX)
    queries = spark.createDataFrame([*enumerate([*clustered(30, 1, spread), rows[50]]), (99, None), (98, [0.0] * 6)], QUERIES)
    got, report = vectors.VectorIndex.build(index, cells, block=block).nearest(queries, 5)
    good = index.filter("id < 900")
    want = retrieval.nearest(queries.filter("query_id < 90"), good, 5)
    plain = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert plain(got) == plain(want)
    seen = report.first()
    assert seen["scored"] <= seen["pairs"]
    if spread < 1:
        assert seen["scored"] < 0.6 * seen["pairs"]  # clusters are skipped


def test_few_vectors_and_none(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)
    assert vectors.VectorIndex.build(spark.createDataFrame([], INDEX)).nearest(queries, 3)[0].count() == 0
    few = vectors.VectorIndex.build(spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 2.0])], INDEX)).nearest(queries, 3)[0]
    assert [(r["id"], r["rank"]) for r in few.orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_fitting_is_the_same_each_time():
    sample = np.array(clustered(300, 2))
    assert (vectors.fit(sample, 8) == vectors.fit(sample, 8)).all() and len(vectors.fit(sample[:3], 8)) == 3


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("same", [[], ["label"]])
def test_nearest_equals_comparing_all(spark, monkeypatch, few, same):
    """Copies, scores that differ beyond the digits of the SQL, zeros, nulls and vectors of another size; with blocks of a few rows, and without a broadcast."""
    monkeypatch.setattr(retrieval, "PACKED", 16)
    if not few:
        monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 2)
    r = random.Random(3)
    rows = [[r.gauss(0, 1) for _ in range(3)] for _ in range(60)]
    rows[20:30] = [rows[5]] * 10
    rows += [[1.0, 1e-7, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0], None, [1.0, None, 0.0], [1.0, 2.0], []]
    index = [(k, v, None if k % 13 == 12 else k % 3) for k, v in enumerate(rows)]
    queries = [(100 + k, v, label) for k, (v, label) in enumerate([([1.0, 0.0, 0.0], 0), ([1.0, 0.0, 0.0], 1), (rows[5], 2), (None, 0), ([0.0, 0.0, 0.0], 1), ([2.0, 1.0], 2), (rows[1], None)])]
    types = "long, {} array<double>, label int"
    got = retrieval.nearest(spark.createDataFrame(queries, f"query_id {types.format('query')}"), spark.createDataFrame(index, f"id {types.format('vector')}"), 7, same)
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()  # no pair is a row

    def score(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return None
        return round(sum(x * y for x, y in zip(a, b)) / sum(x * x for x in a) ** 0.5 / sum(x * x for x in b) ** 0.5, 9)

    want = []
    for q, v, label in queries:
        found = [(score(v, w), k) for k, w, other in index if not same or label is not None and label == other]
        found.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        want += [(q, n + 1, k, s) for n, (s, k) in enumerate(found[:7])]
    assert sorted((x["query_id"], x["rank"], x["id"]) for x in got.collect()) == [w[:3] for w in want]
    plain = {(x["query_id"], x["rank"]): x["score"] for x in got.collect()}
    assert all((s is None) == (plain[q, n] is None) and (s is None or abs(plain[q, n] - s) < 2e-9) for q, n, _, s in want)
