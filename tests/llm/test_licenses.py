from __future__ import annotations

import random
import re

import pytest
from helpers import documents, text
from pyspark.sql import SparkSession

from quillmark.llm import licenses, queries, words
from quillmark.llm.licenses import Template

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(value: str | None) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value or ""))


def plain(value: str | None, templates: list[Template], threshold: float, stride: int) -> tuple:
    """(n_words, blocks, places) with every block against every template."""
    w = plain_words(value)
    blocks, places = set(), set()
    for t, template in enumerate(templates):
        phrase = template.text.split()
        mine = [p for p in range(len(w)) if template.phrase and w[p : p + len(phrase)] == phrase]
        places |= {(t, p) for p in mine}
        for b in range(max(1, -(-len(w) // stride) - 1) if w else 0):
            share = len(set(phrase) & set(w[b * stride : (b + 2) * stride])) / len(set(phrase))
            if share >= (1 if template.phrase else threshold) and (not template.phrase or any(b * stride <= p < (b + 2) * stride for p in mine)):
                blocks.add((t, b * stride, min(len(w), (b + 2) * stride), share))
    return len(w), sorted(blocks), sorted(places)


def test_words_equal_the_pattern() -> None:
    values = ["A-b_c 9é\x7fÀß x", "", "   ", "İstanbul ẞ \x00 a", "x" * 50 + " " + "é" * 50]
    for value in values:
        for size in (1, 7, 1 << 20):
            assert [w.decode() for piece in words.pieces(value.encode(), size) for w in piece] == plain_words(value)


@pytest.mark.parametrize("threshold, stride", [(0.8, 16), (0.5, 8), (1.0, 128)])
def test_equals_every_block_against_every_template(spark: SparkSession, threshold: float, stride: int) -> None:
    r = random.Random(3)
    pool = [f"w{k}" for k in range(30)]
    templates = [Template(" ".join(r.choices(pool, k=r.randrange(2, 8))), f"l{k}") for k in range(12)] + [Template("w1 w2", "p", True), Template("w3 w4 w3", "q", True), Template("w5", "one", True)]
    values = [" ".join(r.choices(pool, k=r.randrange(0, 90))) for _ in range(150)] + [None, "", "w1", "W3 w4. W3 w4 w3"]
    found = licenses.scan(documents(spark, list(enumerate(values))), templates=templates, threshold=threshold, stride=stride)
    got = {r["doc_id"]: (r["n_words"], sorted((b["template"], b["first_word"], b["end_word"], b["containment"]) for b in r["blocks"]), [(p["template"], p["first_word"]) for p in r["places"]]) for r in found.collect()}
    assert got == {k: plain(v, templates, threshold, stride) for k, v in enumerate(values)}
    assert any(v[1] for v in got.values()) and any(v[2] for v in got.values())


def test_notices_and_phrases(spark: SparkSession) -> None:
    rows = [
        (1, text(1, 300) + "\nReleased under the MIT License. " + text(2, 300)),
        (2, text(3, 500) + "\nLicensed under CC BY-NC 4.0."),
        (3, "mit der license: nothing"),
        (4, "Redistribution and use in source and binary forms, with or without changes, are permitted provided that the following conditions hold"),
        (None, "APACHE LICENSE and mit   license, Mit-License"),
    ]
    found = {r["doc_id"]: r for r in licenses.digest(licenses.scan(documents(spark, rows))).collect()}
    assert (found[1]["base_labels"], found[1]["labels"], found[1]["n_base"], found[1]["first_word"], found[1]["last_word"]) == ("mit", "mit", 1, 303, 303)
    assert (found[2]["base_labels"], found[2]["labels"], found[2]["score"], found[2]["first_word"]) == ("", "cc", 1.0, None)
    assert (found[3]["labels"], found[3]["score"]) == ("", 0.0)
    assert found[4]["labels"] == "bsd" and 0.8 <= found[4]["score"] < 1
    assert (found[None]["base_labels"], found[None]["n_base"], found[None]["first_word"], found[None]["last_word"]) == ("apache,mit", 3, 0, 5)


def test_edges(spark: SparkSession) -> None:
    """Empty table, repeated rows, clashing names, a long text, templates out of bounds."""
    assert licenses.scan(documents(spark, [])).count() == 0
    frame = spark.createDataFrame([(1, "mit license", 5, "x")] * 3, "doc_id int, text string, n_words int, key string")
    assert [(r["n_base"], r["doc_id"]) for r in licenses.digest(licenses.scan(frame)).collect()] == [(1, 1)] * 3
    long = "a b c " * 2_000_000 + "mit license"
    row = licenses.digest(licenses.scan(documents(spark, [(1, long)]))).first()
    assert (row["n_words"], row["first_word"]) == (6_000_002, 6_000_000)
    with pytest.raises(ValueError, match="templates"):
        licenses.Index([Template("", "x")], 0.8, 128)


def test_query_equals_its_sql(spark: SparkSession) -> None:
    import duckdb

    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = duckdb.sql(queries.ORACLES["op12_licenses"])
    columns = want.columns
    got = sorted(tuple(str(r[c]) for c in columns) for r in queries.QUERIES["op12_licenses"](spark, folder).collect())
    assert got == sorted(tuple(map(str, r)) for r in want.fetchall())
    assert any(r[columns.index("base_labels")] for r in got)
