from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark import schemas
from quillmark.functions import extract, links
from quillmark.operators import analysis, evaluation, feedback, report


def test_signed_links(spark):
    want = hmac.new(b"k", b"26-1", hashlib.sha256).hexdigest()
    assert links.sign("26-1", "k") == want and links.verify("26-1", want, "k") and not links.verify("26-2", want, "k") and not links.verify("26-1", "short", "k")
    df = spark.createDataFrame([("26-1",), (None,)], "s string").select(links.signed(F.col("s"), "k").alias("t"))
    assert [r["t"] for r in df.collect()] == [want, None]


GOOD = {"decision_gate": "PASS", "recommandation": "HAUTE_PRIORITE", "score_semantique_global": 8.8, "score_secteur": 9, "score_expertise": 9, "score_posture": 8, "confidence": "HIGH"}


@pytest.mark.parametrize(
    ("answer", "faults"),
    [(json.dumps(GOOD), []), ("Voici : " + json.dumps(GOOD) + " fin", []), (json.dumps({**GOOD, "score_secteur": 11}), ["score_secteur"]), (json.dumps({**GOOD, "decision_gate": "MAYBE"}), ["decision_gate"]), (json.dumps({k: v for k, v in GOOD.items() if k != "confidence"}), ["confidence"])],
)
def test_validation(spark, answer, faults):
    row = spark.createDataFrame([(answer,)], "a string").select(analysis.parsed(F.col("a")).alias("s")).select("s", analysis.faults(F.col("s")).alias("f")).first()
    assert row["f"] == faults


def test_no_answer_is_null(spark):
    assert spark.createDataFrame([("none",)], "a string").select(analysis.parsed(F.col("a")).alias("s")).first()["s"] is None
    row = spark.range(1).select(analysis.fallback(F.lit(80)).alias("s")).first()["s"]
    assert row["score_semantique_global"] == pytest.approx(0.4) and row["recommandation"] == "NON_PERTINENT"


@pytest.mark.parametrize(("answer", "ok"), [('{"type": "A", "terms": ["x"], "confidence": 0.9, "explanation": "e"}', True), ('{"type": "B", "term": "x", "confidence": 1, "explanation": "e"}', True), ('{"type": "B", "confidence": 1, "explanation": "e"}', False), ('{"type": "D", "confidence": 1, "explanation": "e"}', False), ('{"type": "C", "confidence": 1.5, "explanation": "e"}', False), ("{", False)])
def test_reasons(spark, answer, ok):
    assert (spark.createDataFrame([(answer,)], "a string").select(analysis.valid_reason(F.col("a")).alias("r")).first()["r"] is not None) == ok


def test_prompt_has_defaults(spark):
    m = "array<struct<category string, weight int, terms array<string>>>"
    df = spark.createDataFrame([("T", None, "", ["a", "b"], 40, "LOW", [("transport", 3, ["x"])], [], [])], f"title string, acheteur string, description string, keywords array<string>, keyword_score int, confidence string, sector_matches {m}, expertise_matches {m}, red_flags array<string>")
    lines = df.select(analysis.prompt(df).alias("p")).first()["p"].split("\n")
    assert lines == ["Titre : T", "Organisme : Non communiqué", "Description : Non disponible", "Mots-clés : a, b", "Score : 40/100, confiance LOW", "Secteurs : transport", "Expertises : aucune", "Exclusions : aucun"]


def test_retries():
    calls, waits = [], []

    def scorer(rows):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return rows

    assert len(analysis.retrying(scorer, sleep=waits.append)(pd.DataFrame({"a": [1]}))) == 1 and waits == [65.0, 70.0]
    with pytest.raises(ConnectionError):
        analysis.retrying(lambda r: (_ for _ in ()).throw(ConnectionError()), attempts=2, sleep=waits.append)(pd.DataFrame())


def test_conditions_and_embedding(spark):
    long = "x" * 40
    df = spark.createDataFrame([("1", long, "", ["a", "b"]), ("2", "short", "", ["a"]), ("3", long, "", []), ("4", long, None, None)], "id string, title string, description string, conditions array<string>")
    out = {r["id"]: (r["status"], r["verdicts"]) for r in analysis.verify_conditions(df, lambda t, c: [f"{x}:{len(t)}" for x in c]).collect()}
    assert out == {"1": ("verified", ["a:41", "b:41"]), "2": ("unknown", ["unknown"]), "3": ("skipped", []), "4": ("skipped", [])}
    chunks = spark.createDataFrame([(str(k), "c" * k) for k in range(45)], "id string, content string").coalesce(1)

    def embedder(texts):
        assert len(texts) <= 20
        return [[float(len(t)), 0.5] for t in texts]

    assert all(r["vector"] == [float(r["id"]), 0.5] for r in analysis.embed(chunks, embedder).collect())


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert [one(extract.record_id(F.lit(x))) for x in ('{"idweb": "1", "id": "2"}', '{"boamp_id": "3"}', '{"id": 4}', "{}")] == ["1", "3", "4", None]
    t = lambda d, *a: one(feedback.simulated_term(F.lit(d), *(F.lit(x).cast("string") for x in a)))
    assert [t("include", "b", "f", "t", "r"), t("include", "", "f", "t", "r"), t("exclude", "b", "", "t", "r"), t("exclude", "b", None, None, "r")] == ["b", "r", "t", "r"]
    assert one(feedback.correction_type(F.lit(None).cast("string"), F.lit("include"), F.lit("rag_chunk"))) == "keyword_boost"


def test_chunks_and_mail(spark):
    now = dt.datetime(2024, 1, 1)
    fb = spark.createDataFrame([("1", "s", "c", "t", None, "rag_chunk", "Ne pas retenir le nettoyage", None, None, None, "applied", "chat", None, None, now, None), ("2", "s", "c", "t", None, "rag_chunk", "autre", None, None, None, "rejected", "chat", None, None, now, None)], schemas.FEEDBACK)
    p = spark.createDataFrame([("c", "nettoyage"), ("c", "autre")], "client_id string, value string")
    assert {r["value"]: r["duplicate_of"] for r in feedback.duplicate_chunks(p, fb).collect()} == {"nettoyage": "1", "autre": None}
    assert [tuple(r) for r in feedback.chunk_vector(fb).collect()] == [("feedback_1", "Ne pas retenir le nettoyage", "user_feedback")]
    rows = spark.createDataFrame([(1, "HIGH", "a <b>", None, None, "u", None, None, "hors sujet")], "position int, priority string, title string, acheteur string, deadline string, url_ao string, human_readable_reason string, semantic_reason string, rejet_raison string")
    assert report.render_html(report.mail_rows(rows)).first()["html"] == "<tr><td>1</td><td>HIGH</td><td>a &lt;b&gt;</td><td>Non communiqué</td><td>Non précisée</td><td>hors sujet</td></tr>"


def test_stratified_sample(spark):
    df = spark.createDataFrame([(str(k), "PASS" if k < 3 else "REJECT", k) for k in range(10)], "source_id string, decision_gate string, analyzed_at int")
    assert sorted(r["source_id"] for r in evaluation.stratified(df, 4).collect()) == ["1", "2", "8", "9"]


def test_embedded_rows_leave_as_they_are_made(spark):
    """Of a large Arrow batch only a few calls' texts are Python objects at once, and its rows go on before the rest is asked."""
    import pyarrow as pa

    calls = []

    class Chunks:
        columns, schema = ["id", "content"], spark.createDataFrame([], "id string, content string").schema

        def mapInArrow(self, run, schema):
            return run

    run = analysis.embed(Chunks(), lambda texts: calls.append(len(texts)) or [[float(len(t)), 1.0] for t in texts])
    rows = [(str(k), None if k == 7 else "c" * k) for k in range(1010)]
    source = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t or "" for _, t in rows])], ["id", "content"])
    made = run(iter([source, source.slice(0, 0)]))
    first = next(made)
    assert len(calls) <= analysis.EMBEDDED and max(calls) <= 20
    parts = [first, *made]
    assert sum(p.num_rows for p in parts) == 1010 and max(p.num_rows for p in parts) <= 20 * analysis.EMBEDDED
    assert [v for p in parts for v in p.column(2).to_pylist()] == [[float(len(t or "")), 1.0] for _, t in rows]
