from __future__ import annotations

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import SparkSession

from quillmark.llm import patterns, queries

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
START = dt.datetime(2024, 1, 1)


def plain(rows: list[tuple], gap: float = 900) -> list[tuple]:
    """(client, match_no, first, last, n, sum, labels) row by row, with Python's backtracking."""
    out = []
    clients: dict[int, list] = {}
    for r in {r for r in rows if r[3] is not None and r[1] is not None}:
        clients.setdefault(r[3], []).append(r)
    for client, own in clients.items():
        own.sort(key=lambda r: (r[1], r[0]))
        cents = [None if r[5] is None else math.floor(100 * r[5] + 0.5) for r in own]
        near = [k > 0 and (own[k][1] - own[k - 1][1]).total_seconds() <= gap for k in range(len(own))]
        at = number = 0
        while at < len(own):
            if cents[at] is None:
                at += 1
                continue

            def fits(k: int, letter: str, a: int = at) -> bool:
                if not near[k] or cents[k] is None:
                    return False
                if letter == "P":
                    return own[k][4] == "view" and cents[k] >= cents[a]
                if own[k][4] in (None, "error") or cents[k - 1] is None:
                    return False
                return cents[k] < cents[k - 1] if letter == "D" else cents[k] > cents[k - 1]

            k = at + 1
            letters = ["A"]
            while k < len(own) and (fits(k, "D") or fits(k, "U")):
                letters.append("D" if fits(k, "D") else "U")
                k += 1
            while k > at and not (k < len(own) and fits(k, "P")):
                k -= 1
                letters = letters[: k - at]
            if k == at:
                at += 1
                continue
            letters.append("P")
            k += 1
            while k < len(own) and fits(k, "D"):
                letters.append("D")
                k += 1
            number += 1
            out.append((client, number, own[at][0], own[k - 1][0], k - at, sum(cents[at:k]), "".join(letters)))
            at = k - 1
    return sorted(out)


def clicks(seed: int, n: int, clients: int, gaps: tuple[float, ...], kinds: tuple = ("view", "click", "view", "error", None), top: int = 8) -> list[tuple]:
    r = random.Random(seed)
    rows, now = [], START
    for k in range(n):
        now += dt.timedelta(seconds=r.choice(gaps))
        value = None if r.random() < 0.03 else r.randrange(top) / 100 - 0.02
        rows.append((k, None if r.random() < 0.01 else now, now, None if r.random() < 0.02 else r.randrange(clients), r.choice(kinds), value, r.choice(("x", None))))
    return rows + r.sample(rows, n // 10)


def run(spark: SparkSession, rows: list[tuple], **options) -> list[tuple]:
    found = patterns.match_rows(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize(
    "seed, clients, gaps, kinds, top",
    [
        (1, 5, (1, 60, 200), ("view", "click", "view", "error", None), 8),
        (2, 1, (0, 1, 899.999999, 900, 900.000001), ("view", "click"), 30),
        (3, 2, (1,), ("view", "click", "buy"), 1000),
        (4, 40, (1,), ("view", "error", "click"), 4),
    ],
)
def test_equals_a_plain_search(spark: SparkSession, seed: int, clients: int, gaps: tuple, kinds: tuple, top: int) -> None:
    rows = clicks(seed, 600, clients, gaps, kinds, top)
    assert plain(rows)
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, rows_each=40) == plain(rows)  # many partitions, so that segments cross seams


def test_one_segment_over_many_partitions(spark: SparkSession) -> None:
    """A match of thousands of rows, and none of its rows a place to cut."""
    r = random.Random(5)
    rows = [(k, START + dt.timedelta(seconds=k), START, 1, "click", r.randrange(1, 10**6) / 100, None) for k in range(300)]
    rows[0] = (*rows[0][:5], 0.01, None)
    rows[290] = (*rows[290][:4], "view", 1e5, None)
    found = run(spark, rows, rows_each=30)
    assert found == plain(rows)
    assert found[0][4] >= 291


def test_the_search_in_one_task_equals_python_re() -> None:
    """Symbols against the pattern itself, start by start."""
    r = random.Random(7)
    for _ in range(200):
        rows = np.zeros(60, dtype=patterns.ROW)
        rows["cents"] = [r.randrange(6) for _ in rows]
        rows["ts"] = np.cumsum([r.choice((1, 1, 1, 10)) for _ in rows])
        rows["flag"] = [r.choice((7, 7, 3, 3, 1, 2, 0)) for _ in rows]
        got = [(s, p, e) for s, p, e in patterns.matches(rows, 5)]
        want, at = [], 0
        while at < len(rows):
            word = ""
            for k in range(len(rows)):
                near = k and rows["ts"][k] - rows["ts"][k - 1] <= 5 and rows["flag"][k] & 1
                d = near and rows["flag"][k] & 2 and rows["flag"][k - 1] & 1
                kind = "d" if d and rows["cents"][k] < rows["cents"][k - 1] else "u" if d and rows["cents"][k] > rows["cents"][k - 1] else "-"
                goal = near and rows["flag"][k] & 4 and rows["cents"][k] >= rows["cents"][at]
                word += {"d": "d", "u": "u", "-": "q"}[kind].upper() if goal else {"d": "d", "u": "u", "-": "."}[kind]
            m = re.compile(r".[duDU]*([DUQ])[dD]*").match(word, at) if rows["flag"][at] & 1 else None
            if m is None:
                at += 1
            else:
                want.append((at, m.start(1), m.end() - 1))
                at = m.end() - 1
        assert got == want


def test_edges(spark: SparkSession) -> None:
    """Empty table, nulls only, one row, clashing names, no id."""
    assert run(spark, []) == []
    assert run(spark, [(1, None, None, None, None, None, None), (None, START, None, 1, None, None, None)]) == []
    rows = [(None, START, START, 1, "click", 1.0, None), (None, START + dt.timedelta(seconds=1), START, 1, "view", float("nan"), None), (3, START + dt.timedelta(seconds=2), START, 1, "view", 2.0, None), (4, START + dt.timedelta(seconds=3), START, 1, "view", 2.0, None)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", match_no long, key long")
    assert [tuple(r) for r in patterns.match_rows(frame).collect()] == [(1, 1, 3, 4, 2, 400, "AP")]


def test_long_segments_are_not_searched_from_every_row() -> None:
    """100,000 rows without a cut, goals at the end: the work stays near linear."""
    n = 100_000
    rows = np.zeros(n, dtype=patterns.ROW)
    rows["cents"] = np.random.Generator(np.random.PCG64(3)).integers(0, 10**6, n)
    rows["cents"][::2] += 10**6
    rows["ts"], rows["flag"] = np.arange(n), 7
    found = patterns.matches(rows, 5)
    assert found[0][0] == 0 and all(a[2] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_query_equals_its_sql(spark: SparkSession) -> None:
    import duckdb

    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW clicks AS SELECT * FROM '{folder}/clicks.parquet'")
    want = duckdb.sql(queries.ORACLES["op11_patterns"])
    columns = want.columns
    got = sorted(tuple(r[c] for c in columns) for r in queries.QUERIES["op11_patterns"](spark, folder).collect())
    assert got == sorted(want.fetchall()) and got
