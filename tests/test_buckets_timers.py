from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmark.sources.buckets import BucketTable
from quillmark.streaming import ingest, timers


def rows(table: BucketTable) -> list[tuple]:
    return sorted((r["k"], r["v"]) for r in table.read().collect())


def frame(spark, *x):
    return spark.createDataFrame(list(x), "k long, v long, turn long")


def test_a_commit_rewrites_the_buckets_of_its_keys_only(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "k", 16)
    assert t.merge(spark.range(500).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("turn")), 0)
    assert len(list(Path(tmp_path, "t/data/commit=0").glob("bucket=*"))) == 16
    assert t.merge(frame(spark, (7, 1, 1), (7, 2, 2), (None, 5, 5)), 1, "turn")
    written = list(Path(tmp_path, "t/data/commit=1").glob("bucket=*"))
    assert len(written) == 1 and [v for v in t.manifest().values()].count(1) == 1
    assert rows(t) == sorted([(k, 0) for k in range(500) if k != 7] + [(7, 2)])
    assert not t.merge(frame(spark, (7, 9, 9)), 1) and not t.merge(frame(spark, (7, 9, 9)), 0)  # replays
    assert dict(rows(t))[7] == 2 and dict((r["k"], r["v"]) for r in t.read(0).collect())[7] == 0


def test_a_commit_that_is_cut_off_is_not_seen(spark, tmp_path, monkeypatch):
    t = BucketTable(spark, str(tmp_path / "t"), "k", 4)
    t.merge(frame(spark, (1, 1, 1), (2, 1, 1)), 0)
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            t.merge(frame(spark, (1, 2, 2), (3, 2, 2)), 1)
    assert rows(t) == [(1, 1), (2, 1)] and list(Path(tmp_path, "t/data/commit=1").glob("bucket=*"))
    assert t.merge(frame(spark, (1, 3, 3)), 1) and rows(t) == [(1, 3), (2, 1)]


def test_deletes_new_columns_old_files_and_a_second_writer(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "k", 4)
    with pytest.raises(ValueError, match="no rows"):
        t.read()
    for n in range(5):
        t.merge(frame(spark, (n, n, n)), n)
    assert t.commits() == [3, 4] and rows(t) == [(n, n) for n in range(5)]
    live = {(v, b) for m in (t.manifest(3), t.manifest(4)) for b, v in m.items()}
    assert {(int(p.parent.name[7:]), int(p.name[7:])) for p in Path(tmp_path, "t/data").glob("commit=*/bucket=*")} == live
    t.merge(spark.createDataFrame([(1, "x")], "k long, w string"), 5, deleted=frame(spark, (2, 0, 0), (None, 0, 0)))
    assert sorted((r["k"], r["v"], r["w"]) for r in t.read().collect()) == [(0, 0, None), (1, None, "x"), (3, 3, None), (4, 4, None)]
    t.merge(frame(spark), 6, deleted=t.read())
    with pytest.raises(ValueError, match="no rows"):
        t.read()
    with pytest.raises(RuntimeError, match="another writer"):
        t._commit(6, {})
    with pytest.raises(ValueError, match="buckets by"):
        BucketTable(spark, t.folder, "k", 8).manifest()


def test_streams_merge_by_bucket(spark, tmp_path):
    source, t = str(tmp_path / "in"), BucketTable(spark, str(tmp_path / "t"), "k", 4)
    frame(spark, (1, 1, 1), (1, 2, 2), (2, 1, 1)).coalesce(1).write.parquet(source)
    go = lambda: ingest.upsert_buckets(ingest.read(spark, source, frame(spark).schema), t, str(tmp_path / "cp"), "turn").awaitTermination()
    go()
    frame(spark, (2, 9, 9), (3, 3, 3)).coalesce(1).write.mode("append").parquet(source)
    go()
    go()
    assert rows(t) == [(1, 2), (2, 9), (3, 3)] and t.commits() == [0, 1]


def test_walk_takes_rows_and_deadlines_in_order():
    minute = 60_000_000
    said = timers.walk(timers.RETRY, "idle", None, [(0, 1, "gap"), (30 * minute, 2, "gap"), (60 * minute, 3, "filled"), (90 * minute, 4, "gap"), (100 * minute, 5, "filled")], 200 * minute)
    assert said == ("idle", None, [(0, "gap", "pending"), (60 * minute, "retry", "idle"), (90 * minute, "gap", "pending"), (100 * minute, "filled", "idle")])
    status, due, out = timers.walk(timers.RETRY, "pending", 5, [], 4)
    assert (status, due, out) == ("pending", 5, [])


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_and_order_of_arrival_do_not_matter(spark, tmp_path, seed):
    """Rows out of order within the watermark, in several files and two starts on one checkpoint, against one walk over all."""
    r = random.Random(seed)
    events = [("w", 900, 1, "ask"), ("w", 100, 2, "propose"), ("w", 90, 3, "ask")] + [(r.choice("abc"), 60 * k + r.randrange(300), k, r.choice(["propose", "ask", "ask", "confirm", "reject", "deactivate"])) for k in range(60)] + [(r.choice("abc"), 86_400 * 9 + k, 100 + k, "ask") for k in range(3)] + [("end", 86_400 * 20, 999, "propose"), (None, 5, 1, "ask")]
    schema = "id string, at timestamp, seq long, event string"
    say = lambda part: spark.createDataFrame(part, "id string, s long, seq long, event string").select("id", F.timestamp_seconds("s").alias("at"), "seq", "event").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with timers.rocksdb(spark):
        for part in (events[:20], events[20:60], events[60:]):
            say(part)
            stream = ingest.read(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
            timers.transitions(stream, timers.APPROVAL).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    until = 1_000_000 * (86_400 * 20 - 600)
    want = [(k, at, e, s) for k in ("a", "b", "c", "w") for at, e, s in timers.walk(timers.APPROVAL, "draft", None, [(1_000_000 * s, q, e) for i, s, q, e in events if i == k], until)[2]]
    got = [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("id", F.unix_micros("at"), "event", "status").collect()]
    assert sorted(got) == sorted(want) and any(x[2] == "expire" for x in got)
