from __future__ import annotations

import duckdb
import pandas as pd
from helpers import documents, text

from quillmark.llm import linededup

LOG = [f"user u{k} logged in from host h{k} at {k}:00 today" for k in range(6)]
HEAD = ["alpha beta gamma delta epsilon zeta eta theta omega", "alpha beta gamma delta epsilon zeta eta theta kappa", "alpha beta gamma delta epsilon zeta eta theta lambda"]
ROWS = [
    (1, "\n".join(["© all rights reserved", text(1, 9), LOG[0]])), (2, "\n".join(["© all rights reserved", text(2, 9), LOG[1]])), (3, "\n".join(["  © all rights reserved ", text(3, 9), LOG[2], LOG[3]])),
    (4, "\n".join([HEAD[0], "", text(4, 8)])), (5, "\n".join([HEAD[1], "", text(5, 8)])), (6, "\n".join([HEAD[2], "12 34", text(6, 8)])), (7, "12 34\n12 35"), (8, ""), (9, text(9, 20000)), (10, "\n\n"), (11, "Étre de sur"), (12, "Étre de sur"),
]


def run(spark, rows):
    return {r["doc_id"]: r for r in linededup.line_dedup(documents(spark, rows)).collect()}


def test_recurring_lines_go_but_for_the_first(spark):
    out = run(spark, ROWS)
    assert "rights" in out[1]["text"] and "rights" not in out[2]["text"] and "rights" not in out[3]["text"]
    assert "logged" in out[1]["text"] and "logged" not in out[3]["text"] and out[3]["n_dropped"] == 3
    assert out[4]["text"].startswith("alpha") and "alpha" not in out[5]["text"] and "alpha" not in out[6]["text"]
    assert out[7]["text"] == "12 34\n12 35" and out[9]["n_dropped"] == 0 and out[11]["text"] == out[12]["text"] == "Étre de sur"
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())


def test_sql_gives_the_same(spark):
    out = linededup.line_dedup(documents(spark, ROWS)).select("doc_id", "n_lines", "n_dropped", "text").collect()
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(ROWS, columns=["doc_id", "text"]))
    assert sorted(map(tuple, out)) == sorted(c.execute(linededup.ORACLE).fetchall())


def test_nulls_repeats_clashing_columns_and_empty(spark):
    df = documents(spark, [(None, "same line"), (1, None), (2, "same line"), (2, "same line"), (3, "same line")]).withColumnRenamed("lang", "n_lines").withColumnRenamed("source", "gone")
    out = linededup.line_dedup(df).collect()
    assert len(out) == 5 and sorted(r["text"] for r in out) == ["", "", "", "", "same line"]
    assert linededup.line_dedup(documents(spark, [])).collect() == []


def test_no_python_on_the_main_path(spark, capsys):
    linededup.line_dedup(documents(spark, ROWS)).explain()
    assert "Python" not in capsys.readouterr().out


def test_texts_of_very_many_recurring_lines(spark):
    """40,000 lines that three documents share: a text is put together in time linear in its lines."""
    names = ["".join(chr(97 + int(d)) for d in str(k)) for k in range(40_000)]
    whole = "\n".join(f"{w} stands in a line alone" for w in names)
    out = run(spark, [(1, whole), (2, f"{whole}\nend"), (3, whole)])
    assert (out[1]["text"], out[2]["text"], out[3]["text"]) == (whole, "end", "") and [out[k]["n_dropped"] for k in (1, 2, 3)] == [0, 40_000, 40_000]
