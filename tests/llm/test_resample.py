from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from helpers import documents, text
from pyspark.sql import SparkSession

from quillmark.llm import queries, resample, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(value: str | None, longest: int, buckets: int) -> list[int]:
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value or ""))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain(rows: list[tuple], target: list[str | None], percent: int = 10, least: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024) -> list[tuple]:
    s, t = Counter(), Counter()
    for _, value in rows:
        s.update(plain_features(value, longest, buckets))
    for value in target:
        t.update(plain_features(value, longest, buckets))
    S, T = sum(s.values()), sum(t.values())
    scored = []
    for key, value in rows:
        f = plain_features(value, longest, buckets)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        scored.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    return sorted([(*r, k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r, None) for r in scored if r[1] < least], key=repr)


@pytest.mark.parametrize("percent, least, buckets, longest", [(10, 20, 10_000, 1), (35, 5, 50, 3)])
def test_equals_a_plain_computation(spark: SparkSession, percent: int, least: int, buckets: int, longest: int) -> None:
    rows = [(k, text(k % 60, 5 + 7 * (k % 11))) for k in range(150)] + [(1000 + k, "the same text " * 9) for k in range(70)]
    rows += [(2000, None), (2001, ""), (2002, "ÀB é-é x9 " * 8), (7, text(3, 40)), (7, text(3, 40))]
    target = [text(500 + k, 30) for k in range(20)] + [None, text(3, 40)]
    found = resample.resample(documents(spark, rows), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string"), percent=percent, least_words=least, buckets=buckets, longest=longest)
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == plain(rows, target, percent, least, buckets, longest)
    assert any(r[4] for r in got)


def test_pieces_and_memory_do_not_matter(monkeypatch: pytest.MonkeyPatch) -> None:
    """Runs across the seams of pieces, and a hasher that forgets."""
    value = text(1, 300)
    want = sorted(plain_features(value, 3, 977))
    whole = words.pieces
    for size in (1, 10, 100):
        monkeypatch.setattr(resample, "pieces", lambda t, size=size: whole(t, size))
        monkeypatch.setattr(resample, "REMEMBERED", 5)
        assert sorted(resample.bucketed(value.encode(), resample.Hasher(977), 3).tolist()) == want


def test_edges(spark: SparkSession) -> None:
    """Empty tables and clashing names."""
    empty = documents(spark, [])
    assert resample.resample(empty, empty).count() == 0
    frame = spark.createDataFrame([(1, "a " * 30, 4, 9), (None, "a " * 30, 4, 9)], "doc_id long, text string, weight int, digest int")
    found = resample.resample(frame, empty, percent=100).collect()
    assert sorted((str(r["doc_id"]), r["n_features"], r["rank"] is not None) for r in found) == [("1", 30, True), ("None", 30, True)]


def test_query_equals_its_sql(spark: SparkSession) -> None:
    import duckdb

    folder = "/root/testdata/sf0.001"
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = duckdb.sql(queries.ORACLES["op13_resample"])
    columns = want.columns
    got = sorted((tuple(r[c] for c in columns) for r in queries.QUERIES["op13_resample"](spark, folder).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
