from __future__ import annotations

import random

import pytest
from helpers import SCHEMA, documents, text, words

import corpus_pipeline

BENCH = [(1, text(901, 30)), (2, text(902, 25))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    rows, labels = [], []
    for k in range(700):
        w = words(k, r.randint(20, 90))
        bad = k % 9 == 0
        if bad:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["grolk", "zurgh", "blarx"]))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    rows += [(1000 + k, rows[1][1]) for k in range(3)]
    rows += [(1100, rows[2][1] + " end")]
    rows += [(1200, text(41, 20) + " " + BENCH[0][1] + " " + text(42, 20)), (1201, BENCH[1][1])]
    rows += [(1300 + k, "the licence line of this text\n" + text(7000 + k, 30)) for k in range(5)]
    rows += [(1400, None), (1401, ""), (1402, text(1, 8000))]
    place = str(tmp_path_factory.mktemp("tables"))
    documents(spark, rows).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def test_stages_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in rows} for name, rows in seen.items()}
    toxic = {k for k in range(700) if k % 9 == 0}
    assert len(ids["toxicity"] & toxic) <= 0.05 * len(toxic) and len(set(range(700)) - toxic - ids["toxicity"]) <= 5
    lines = {r["doc_id"]: r["text"] for r in seen["line dedup"]}
    assert ids["line dedup"] == ids["toxicity"] and "licence" in lines[1300] and not any("licence" in lines[1300 + k] for k in range(1, 5))
    assert not ids["n-gram Jaccard join"] & {1100} and 1400 in ids["n-gram Jaccard join"]
    assert ids["n-gram Jaccard join"] - ids["benchmark decontamination"] == {1200, 1201}
    assert ids["packing"] == ids["benchmark decontamination"]


def test_run_and_contract(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 500


def test_every_query_is_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.collect() == []


def test_clashing_columns_and_nulls_survive_every_stage(spark, folder):
    names = ["score", "predicted", "held_out", "n_lines", "n_dropped", "roles", "gone", "node", "key", "component", "window", "shard"]
    rows = [(k, None if k == 3 else text(k, 40), *(f"{n}{k}" if k % 2 else None for n in names)) for k in range(12)] + [(None, text(5, 41), *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    want = {r[0]: r[2:] for r in rows}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", *names]
        assert {r["doc_id"]: tuple(r[n] for n in names) for r in docs.collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()} == set(want)


def test_rows_that_share_an_id_are_judged_one_by_one(spark, folder):
    t, u = text(61, 40), text(62, 40)
    docs = documents(spark, [(1, t), (2, t), (2, u), (2, u), (3, None), (3, None), (None, t), (None, text(63, 30))])
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, folder).collect()]
    assert sorted(kept, key=str) == sorted([(1, t), (2, u), (3, None), (3, None), (None, t), (None, text(63, 30))], key=str)
