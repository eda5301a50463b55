from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillmark import schemas
from quillmark.operators import canonical, changes, dedup, evaluation, feedback, merge, report, retrieval, retry, routing

T = dt.datetime


def raw(spark, *records):
    return spark.read.schema(schemas.RAW_RECORD).json(spark.sparkContext.parallelize(records))


REGIONS = [("75", "Île-de-France"), ("92", "Île-de-France"), ("69", "Auvergne-Rhône-Alpes")]


def test_bulletin_records_in_each_wrapping(spark):
    a = '{"idweb": "26-1", "objet": "T", "nomacheteur": "B", "dateparution": "2024-01-02", "type_marche": "[\\"SERVICES\\"]", "code_departement": "[\\"75\\", \\"92\\"]", "donnees": "{\\"IDENTITE\\": {\\"MEL\\": \\"a@b.fr\\"}}"}'
    b = f'{{"fields": {a.replace("26-1", "26-2")}}}'
    c = f'{{"record": {{"fields": {a.replace("26-1", "26-3").replace(chr(92) + chr(34) + "MEL", "broken")}}}}}'
    rows = canonical.from_bulletin(raw(spark, a, b, c), spark.createDataFrame(REGIONS, "department string, region string")).select("tender.*").orderBy("source_id").collect()
    assert [r["source_id"] for r in rows] == ["26-1", "26-2", "26-3"]
    assert rows[0]["identity"]["region"] == "Île-de-France" and rows[0]["classification"]["type_marche"] == "SERVICES" and rows[0]["metadata"]["acheteur_email"] == "a@b.fr"
    assert rows[2]["metadata"]["acheteur_email"] is None


def test_bulletin_without_mapping_keeps_the_code(spark):
    rows = canonical.from_bulletin(raw(spark, '{"idweb": "1", "code_departement": "99"}'), spark.createDataFrame(REGIONS, "department string, region string")).select("tender.identity.region").collect()
    assert rows[0][0] == "99"


def test_bulletin_conditions(spark):
    base = {"type_marche": "SERVICES", "dateparution": "2024-01-02", "nature_categorise": "appeloffre/standard"}
    import json

    cases = {"ok": {}, "late": {"datelimitereponse": "2024-01-05"}, "far": {"datelimitereponse": "2024-01-09"}, "given": {"titulaire": "X"}, "other": {"nature_categorise": "z"}, "linked": {"nature_categorise": "z", "annonce_lie": "1"}, "works": {"type_marche": "TRAVAUX"}, "day": {"dateparution": "2024-01-03"}}
    rows = canonical.from_bulletin(raw(spark, *(json.dumps({"idweb": k, **base, **v}) for k, v in cases.items())))
    assert {r[0] for r in canonical.keep_bulletin(rows, "2024-01-02", "2024-01-02").select("tender.source_id").collect()} == {"ok", "far", "linked"}


def test_feed_items(spark):
    item = ("g1", "http://l", "Conseil en stratégie", "<p>Nom officiel: Ville X</p> Annonce n° 26-12345 SIRET 12345678901234", None, "Tue, 02 Jan 2024 10:00:00 GMT", "2024-01-02T10:00:00Z", None, "92 - Neuilly", "c", ["Services", "SERVICES", " audit "])
    gone = ("g2/attribution/", None, "x", "y", None, None, None, None, None, None, None)
    cancelled = ("g3", None, "Marché annulé", "Fournitures", None, None, None, None, "01 - B", None, None)
    df = canonical.from_rss(spark.createDataFrame([item, gone, cancelled], schemas.RSS_ITEM), spark.createDataFrame(REGIONS, "department string, region string"))
    rows = {r["tender"]["source_id"]: r for r in df.collect()}
    t = rows["g1"]["tender"]
    assert rows["g1"]["notice_number"] == "26-12345" and t["identity"]["acheteur"] == "Ville X" and t["identity"]["region"] == "Île-de-France" and t["metadata"]["siret"] == "12345678901234" and t["lifecycle"]["publication_date"] == "2024-01-02" and t["content"]["keywords"] == ["audit"]
    assert rows["g2/attribution/"]["is_award"] and rows["g3"]["tender"]["lifecycle"]["etat"] == "AVIS_ANNULE" and rows["g3"]["tender"]["identity"]["region"] is None
    assert {r[0] for r in canonical.keep_rss(df, "2024-01-02").select("tender.source_id").collect()} == {"g1", "g3"}
    assert {r[0] for r in canonical.keep_rss(df, type_marche="SERVICES").select("tender.source_id").collect()} == {"g1"}
    flat = {r["source_id"]: r for r in canonical.flatten(df).collect()}
    assert flat["g3"]["is_cancelled"] and not flat["g1"]["is_cancelled"]


KEYS = "id long, source string, source_id string, uuid_procedure string, title string, acheteur string, deadline string, siret string, notice_number string"


def keyed(spark, rows):
    return canonical.dedup_keys(spark.createDataFrame(rows, KEYS))


def test_matching_by_priority(spark):
    stored = keyed(spark, [
        (1, "BOAMP", "26-1", "u1", "Titre", "Ville", "2024-05-01", "111", None), (2, "BOAMP", "26-2", "u2", "Autre", "Ville", None, None, None),
        (3, "BOAMP", "26-3", "u2", "Tïtre!", "VILLE", "2024-05-01T10:00:00Z", None, None), (4, "BOAMP", "26-4", None, "Z", "Z", "2024-06-01", "222", None),
    ])
    new = keyed(spark, [
        (10, "RSS", "a", "u2", "Titre", "Ville", "2024-05-01", "222", "26-1"), (11, "RSS", "b", "u2", "Titre", "Ville", "2024-05-01", None, "26-99"), (12, "RSS", "c", "x", "titre", "ville", "2024-05-01", None, None),
        (13, "RSS", "d", None, "n", "n", "2024-06-01", "222", None), (14, "RSS", "e", None, "n", "n", None, "222", None), (15, "RSS", "f", None, "Autre", "Ville", None, None, None),
    ])
    out = {r["id"]: (r["match_strategy"], r["matched_id"]) for r in dedup.match(new, stored).collect()}
    assert out == {10: ("notice_number", 1), 11: ("uuid", 3), 12: ("composite", 3), 13: ("siret_deadline", 4), 14: (None, None), 15: ("composite", 2)}
    assert {r["id"] for r in dedup.unmatched(dedup.match(new, stored)).collect()} == {14}
    assert {r["match_strategy"]: r["n"] for r in dedup.strategy_counts(dedup.match(new, stored)).collect()} == {"notice_number": 1, "uuid": 1, "composite": 2, "siret_deadline": 1}


def test_source_id_key_is_for_the_primary_source_without_uuid(spark):
    rows = keyed(spark, [(1, "BOAMP", "9", None, "t", None, None, None, None), (2, "BOAMP", "9", "u", "t", None, None, None, None), (3, "RSS", "9", None, "t", None, None, None, None)]).orderBy("id").collect()
    assert [r["source_id_key"] for r in rows] == ["BOAMP:9", None, None] and rows[0]["composite_key"] == "t||"


def test_already_analysed_and_exemption(spark):
    schema = "source string, source_id string, uuid_procedure string"
    stored = spark.createDataFrame([("A", "1", "u1", "analyzed"), ("A", "2", "u2", "new"), ("A", "1", "u1", "analyzed")], schema + ", status string")
    new = spark.createDataFrame([("A", "1", None, False), ("B", "1", "u1", False), ("A", "2", "u2", False), ("A", "1", "u1", True), ("A", "9", None, None)], schema + ", is_substantial boolean")
    out = dedup.already_analysed(new, stored)
    assert out.count() == 5 and out.filter("known").count() == 3
    assert sorted((r["source_id"], bool(r["is_substantial"])) for r in dedup.to_analyse(new, stored).collect()) == [("1", True), ("2", False), ("9", False)]


def side(**x):
    base = {"budget_max": 100.0, "deadline": "2024-05-01", "cap_eco": None, "cap_tech": None, "type_marche": "S", "region": "R", "title": "abcdefghij"}
    return {**base, **x}


@pytest.mark.parametrize(
    ("old", "new", "fields"),
    [
        ({}, {}, []), ({}, {"budget_max": 120.0}, []), ({}, {"budget_max": 121.0}, ["budget_max"]), ({}, {"budget_max": None}, []), ({"budget_max": 0.0}, {}, []), ({}, {"deadline": "2024-05-08"}, []), ({}, {"deadline": "2024-05-08T01:00:00Z"}, ["deadline"]), ({"deadline": None}, {}, []),
        ({}, {"cap_eco": "{}"}, ["cap_eco"]), ({"cap_tech": "a"}, {"cap_tech": "b"}, ["cap_tech"]), ({}, {"type_marche": "T", "region": "Q"}, ["type_marche", "region"]), ({}, {"region": None}, []), ({}, {"title": "abcdefgh"}, []), ({}, {"title": "abcdefg"}, ["title"]),
    ],
)
def test_changes(spark, old, new, fields):
    s = "struct<budget_max double, deadline string, cap_eco string, cap_tech string, type_marche string, region string, title string>"
    row = spark.createDataFrame([(side(**old), side(**new))], f"o {s}, n {s}").select(changes.changes(F.col("o"), F.col("n")).alias("c")).select("c", changes.is_substantial(F.col("c")).alias("s"), changes.summary(F.col("c")).alias("t")).first()
    assert [c["field"] for c in row["c"]] == fields and row["s"] == bool(fields) and row["t"].count("\n") == max(0, len(fields) - 1)


def test_originals(spark):
    s = "id long, source_id string, normalized_id string, acheteur string, title string, analyzed_at timestamp"
    stored = spark.createDataFrame([(1, "26-1", "261", "V", "Une longue étude", T(2024, 1, 1)), (2, "26-2", "262", "V", "Une longue ÉTUDE bis", T(2024, 1, 2)), (3, "26-3", "263", "W", "x", T(2024, 1, 3)), (4, "26-3b", "263", "W", "x", T(2024, 1, 4))], s)
    a = spark.createDataFrame([("n1", "n1", "V", "Une longue étude", "26-1"), ("26-3", "0", "Q", "q", None), ("n2", "n2", "V", "une longue étude", "none"), ("n3", "263", "Q", "q", None), ("n4", "n4", "Q", "q", None)], "source_id string, normalized_id string, acheteur string, title string, annonce_lie string")
    assert {r["source_id"]: r["original_id"] for r in changes.originals(a, stored).collect()} == {"n1": 1, "26-3": 3, "n2": 2, "n3": 4, "n4": None}


def test_history(spark):
    entry = f"array<struct<at string, changes {changes.CHANGE.join(['array<', '>'])}>>"
    stored = spark.createDataFrame([("1", None, None, None), ("2", [], 1, True)], f"source_id string, history {entry}, rectification_count int, is_rectified boolean")
    amended = spark.createDataFrame([("1", [("title", None, None, 0.5)])], f"source_id string, changes array<{changes.CHANGE}>")
    rows = {r["source_id"]: r for r in changes.with_history(stored, amended, "2024-01-01").collect()}
    assert rows["1"]["history"][0]["changes"][0]["field"] == "title" and rows["1"]["rectification_count"] == 1 and rows["1"]["is_rectified"] and rows["2"]["rectification_count"] == 1


def test_routes(spark):
    rows = [(None, False, True, False, False, "context"), (1, True, False, False, True, "cancelled"), (1, False, True, False, True, "minor"), (1, False, True, True, True, "skip"), (1, False, True, True, False, "substantial"), (None, False, False, None, None, "new")]
    df = spark.createDataFrame(rows, "o int, c boolean, a boolean, s boolean, k boolean, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", routing.route(F.col("o").isNotNull(), F.col("c"), F.col("a"), F.col("s"), F.col("k"))).collect())


def test_analysis_and_end(spark):
    df = spark.createDataFrame([("a", 50, 40, 15, "2024-03-31", 90), ("b", 0, 0, 0, None, 10)], "source_id string, sector_score int, expertise_score int, posture_score int, deadline string, keyword_score int")
    rows = {r["source_id"]: r for r in routing.finish(routing.analyse(df), "2024-03-01").collect()}
    assert rows["a"]["semantic"]["recommandation"] == "HAUTE_PRIORITE" and rows["a"]["priority"] == "HIGH" and rows["b"]["final_score"] is None and rows["b"]["priority"] == "LOW"
    assert rows["a"]["final_score"] == pytest.approx(9 * 0.5 + 0.27 + 1.0)


def test_reference_branch_of_skips_is_dead(spark):
    """A skipped tender has fewer than 45 points, so its price never reaches the medium mark."""
    df = spark.range(101).select(F.col("id").cast("int").alias("keyword_score"))
    assert routing.price_skipped(df).filter("keyword_score < 45 AND priority = 'MEDIUM'").count() == 0


def test_mail_mode(spark):
    key = "client_id string, since string, until string"
    req = spark.createDataFrame([("a", "1", None), ("b", "1", "2"), ("c", "1", None)], key)
    log = spark.createDataFrame([("b", "1", "2", T(2024, 1, 1)), ("c", "1", None, T(2024, 1, 5))], key + ", sent_at timestamp")
    new = spark.createDataFrame([("b", T(2024, 1, 2)), ("c", T(2024, 1, 2))], "client_id string, analyzed_at timestamp")
    assert {r["client_id"]: r["mode"] for r in report.mail_mode(req, log, new).collect()} == {"a": "FULL", "b": "DELTA", "c": "CONFIRMATION"}


def test_report_pieces(spark):
    rows = spark.createDataFrame([(k, "HIGH" if k % 2 else "LOW", 5.0 if k else None, False, k == 1, 40) for k in range(130)], "id int, priority string, semantic_score double, is_cancelled boolean, skip boolean, keyword_score int")
    assert report.totals(rows).first().asDict() == {"total": 130, "llm_calls": 128, "cancelled": 0, "mean_keyword_score": 40.0}
    top = report.capped(rows, report.low_tier(F.col("skip"), F.lit(None).cast("string")), [F.asc("id")])
    assert top.count() == 100 and {r["omitted"] for r in top.collect()} == {30} and max(r["position"] for r in top.collect()) == 100
    assert report.completeness(rows, 140).first()["status"] == "INCOMPLETE" and report.completeness(rows, 130).first()["missing_ratio"] == 0
    named = top.withColumns({"title": F.lit("T"), "acheteur": F.lit(None).cast("string")})
    assert report.render_text(named).orderBy("position").first()["line"] == "1. [LOW] T — ?"


def test_known_buyers(spark):
    clients = spark.createDataFrame([("sncf", ["SNCF Réseau", "TER"], "historical"), ("ville de lyon", [], "prospect"), ("lyon metropole habitat", [], "prospect")], "nom_normalise string, aliases array<string>, statut string").coalesce(1)
    buyers = spark.createDataFrame([("Sncf",), ("SNCF réseau Sud",), ("Métropole Lyon Habitat",), ("Ter",), ("",), (None,), ("Autre",)], "buyer string")
    out = {r["buyer"]: (r["nom_normalise"], r["match_type"], r["match_score"], r["match_confidence"]) for r in retrieval.known_buyer(buyers, clients).collect()}
    assert out["Sncf"] == ("sncf", "exact", 1.0, "HIGH") and out["SNCF réseau Sud"] == ("sncf", "substring", 0.95, "HIGH") and out["Ter"][1] == "exact"
    assert out["Métropole Lyon Habitat"] == ("lyon metropole habitat", "fuzzy", 0.9, "MEDIUM") and out[""][0] is None and out["Autre"] == (None, None, None, None) and len(out) == 7


def test_nearest_in_blocks(spark, monkeypatch):
    import random

    r = random.Random(1)
    index = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(200)], "id long, vector array<float>")
    queries = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(6)], "query_id long, query array<float>")
    a = sorted(map(tuple, retrieval.nearest(queries, index, 4).select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 2)
    assert sorted(map(tuple, retrieval.nearest(queries, index, 4).select("query_id", "id", "rank").collect())) == a and len(a) == 24


RULES = [("r1", "c", "red_flag", "nettoyage", None, "f1", True, T(2024, 1, 1)), ("r2", "c", "red_flag", "entretien des locaux", None, "f2", False, T(2024, 1, 2)), ("r3", "d", "red_flag", "nettoyage", None, None, True, T(2024, 1, 3))]


def test_rules(spark):
    rules = spark.createDataFrame(RULES, schemas.RULE)
    assert {r["id"] for r in feedback.active_rules(rules, "c").collect()} == {"r1"}
    p = spark.createDataFrame([("c", "red_flag", "Nettoyage de vitres"), ("c", "red_flag", "nett"), ("c", "red_flag", "locaux"), ("e", "red_flag", "nettoyage")], "client_id string, type string, value string")
    assert {(r["client_id"], r["value"]): r["duplicate_of"] for r in feedback.duplicates(p, rules).collect()} == {("c", "Nettoyage de vitres"): "r1", ("c", "nett"): "r1", ("c", "locaux"): None, ("e", "nettoyage"): None}
    assert feedback.deactivate(rules, rule_id="r1").filter("active").count() == 1
    with pytest.raises(ValueError, match="several"):
        feedback.deactivate(rules, value="NETTOY")
    with pytest.raises(ValueError, match="no rule"):
        feedback.deactivate(rules, rule_id="r2")


def test_impact_counts(spark):
    rows = [("1", "Nettoyage", "", "HIGH", "2024-02-01", dt.date(2024, 1, 20)), ("2", "x", "le NETTOYAGE", "LOW", None, dt.date(2024, 1, 20)), ("3", "nettoyage", "", "LOW", "2024-01-01", dt.date(2024, 1, 20)), ("4", "nettoyage", "", "LOW", None, dt.date(2023, 1, 1))]
    t = spark.createDataFrame(rows, "source_id string, title string, description string, priority string, deadline string, analyzed_at date")
    assert feedback.impact(t, "nettoyage", "2024-01-25").first().asDict() == {"total": 3, "open": 2, "high_medium": 1, "low": 1}
    assert {(r["source_id"], r["effect"]) for r in feedback.simulate(t, "nettoyage", "exclude", "2024-01-25").collect()} == {("1", "would_be_excluded"), ("2", "correctly_excluded"), ("3", "correctly_excluded")}
    assert {r["effect"] for r in feedback.simulate(t, "nettoyage", "include", "2024-01-25", only_open=True).collect()} == {"would_be_included", "correctly_excluded"}


def test_feedback_history_details_and_revert(spark):
    def row(i, sid, kind, status, at):
        return (i, sid, "c", f"text {i}", None, kind, None, None, None, None, status, "chat", None, None, T(2024, 1, at), None)

    fb = spark.createDataFrame([row("f1", "s", "keyword_red_flag", "applied", 1), row("f2", "s", "keyword_red_flag", "applied", 2), row("f3", "s", "rag_chunk", "applied", 3), row("f4", "s", "rag_chunk", "rejected", 4), row("f5", "s", "rag_chunk", "applied", 5)], schemas.FEEDBACK)
    rules = spark.createDataFrame(RULES, schemas.RULE)
    assert {r["id"]: r["is_active"] for r in feedback.history(fb, rules).collect()} == {"f1": True, "f2": False, "f3": True, "f4": False, "f5": True}
    t = spark.createDataFrame([("s", "t", "HIGH", "old"), ("z", "t", None, "old")], "source_id string, title string, manual_priority string, reason string")
    d = {r["source_id"]: [f["id"] for f in r["feedbacks"]] for r in feedback.details(t, fb).collect()}
    assert d == {"s": ["f5", "f3", "f2"], "z": []}
    back = {r["source_id"]: r for r in feedback.revert_manual(t, fb).collect()}
    assert back["s"]["manual_priority"] is None and back["s"]["reason"] == "text f1 — text f2 — text f3 — text f5" and back["z"]["reason"] is None
    e = spark.createDataFrame([("a", "draft", 1, 1), ("a", "applied", 2, 1), ("a", "rejected", 2, 0)], "id string, status string, at int, seq int")
    assert feedback.transition(e).first()["status"] == "applied"
    c = spark.range(1).select(feedback.choices(F.array(F.lit("x"), F.lit("y"), F.lit("z"))).alias("c")).first()["c"]
    assert [tuple(x) for x in c] == [("A", "x"), ("B", "y"), ("C", "autre")]


def test_merges(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    up = spark.createDataFrame([(2, "B", 1), (3, "C", 1)], "id int, v string, w int")
    assert sorted(map(tuple, merge.upsert(base, up, "id").collect())) == [(1, "a", None), (2, "B", 1), (3, "C", 1)]
    assert sorted(map(tuple, merge.update(base, up, "id", ["v"]).collect())) == [(1, "a"), (2, "B")]
    assert sorted(map(tuple, merge.insert_new(base, up.select("id", "v"), ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]
    assert [r["id"] for r in merge.delete(base, up).collect()] == [1]
    t = spark.createDataFrame([("1", None, "new"), ("2", None, "new")], "source_id string, etat string, status string")
    assert sorted(map(tuple, merge.cancel(t, t.limit(0).unionByName(spark.createDataFrame([("2", None, None)], t.schema))).collect())) == [("1", None, "new"), ("2", "AVIS_ANNULE", "cancelled")]
    v = merge.violations(base.unionByName(base.filter("id = 1")), ["id"], {"v": F.col("v") != "b"})
    assert {r["rule"]: r["n"] for r in v.collect()} == {"unique id": 1, "v": 1}


def test_retries(spark):
    empty = spark.createDataFrame([], schemas.RETRY_JOB)
    want = spark.createDataFrame([("c", "2024-01-02", "r"), ("c", "2024-01-02", "r"), ("c", "soon", "r"), (None, "2024-01-02", "r")], "clientId string, date string, reason string")
    queue = retry.schedule(empty, want, "2024-01-02T06:00:00Z")
    assert [r["executeAt"] for r in queue.collect()] == ["2024-01-02T07:00:00Z"] and retry.schedule(queue, want, "2024-01-02T06:30:00Z").count() == 1
    assert retry.ready(queue, "2024-01-02T06:59:00Z").count() == 0 and retry.ready(queue, "2024-01-02T07:00:00Z").count() == 1 and retry.has_pending(queue, "c", "2024-01-02")
    done = retry.settle(queue, spark.createDataFrame([("retry-c-2024-01-02", None)], "id string, error string"), "2024-01-02T08:00:00Z")
    assert done.first()["status"] == "completed" and retry.retain(done, "2024-03-02T00:00:00Z").count() == 0 and retry.retain(queue, "2024-03-02T00:00:00Z").count() == 1


def test_evaluation(spark):
    schema = "id string, category string, decision_correct boolean, priority_correct boolean, rag_grounded boolean, policy_cited boolean, error string, level string, placed string, has_gap boolean, old_ia_correct string, expected string"
    rows = [("1", "a", True, True, True, False, None, "haute", "haute", True, "false", "PASS"), ("2", "a", False, True, True, True, "e", "basse", "haute", True, "true", "REJECT"), ("3", "b", True, False, False, True, None, "haute", "non_pertinent", False, "False", "REJECT")]
    df = spark.createDataFrame(rows, schema)
    assert evaluation.accuracy(df).first()["decision_accuracy"] == pytest.approx(2 / 3) and {r["category"]: r["errors"] for r in evaluation.accuracy(df, "category").collect()} == {"a": 1, "b": 0}
    assert {r["level"]: (r["over"], r["under"]) for r in evaluation.level_bias(df, "level", "placed").collect()} == {"haute": (0, 1), "basse": (1, 0)}
    assert evaluation.gap_coverage(df).first().asDict() == {"gap_cases": 2, "gap_right": 1, "old_wrong": 2, "now_right": 2}
    assert evaluation.balanced_accuracy(df, "expected", "decision_correct").first()[0] == pytest.approx(0.75)


def test_equal_proposals_stay_separate(spark):
    rules = spark.createDataFrame([("r1", "c", "red_flag", "nettoyage", True), ("r0", "c", "red_flag", "NETT", True)], "id string, client_id string, type string, value string, active boolean")
    p = spark.createDataFrame([("c", "red_flag", "nettoyage")] * 2 + [("c", "red_flag", None)], "client_id string, type string, value string")
    assert sorted((r["value"] or "", r["duplicate_of"] or "") for r in feedback.duplicates(p, rules).collect()) == [("", ""), ("nettoyage", "r0"), ("nettoyage", "r0")]


def test_large_small_tables_are_an_error(spark):
    from quillmark.operators.small import small

    with pytest.raises(ValueError, match="regions"):
        small(spark.range(5), "the table of regions", 4)
    assert small(spark.range(4), "the table of regions", 4).count() == 4


def test_market_type_is_a_member(spark):
    rows = canonical.from_bulletin(raw(spark, json.dumps({"idweb": "1", "dateparution": "2024-01-02", "nature_categorise": "appeloffre/standard", "type_marche": ["FOURNITURES", "SERVICES"]})))
    assert canonical.keep_bulletin(rows, "2024-01-02", "2024-01-02").count() == 1
    assert canonical.keep_bulletin(rows, "2024-01-02", "2024-01-02", type_marche="TRAVAUX").count() == 0


def test_summary_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], "source string, high long, medium long, low long")
    assert [tuple(r) for r in report.text_summary(empty).collect()] == [("", 0, "Aucun appel d'offres analysé")]
    one = spark.createDataFrame([("BOAMP", 0, 0, 1), ("X", 0, 0, 0)], "source string, high long, medium long, low long")
    assert {tuple(r) for r in report.text_summary(one).collect()} == {("", 0, "1 appel d'offres analysé"), ("", 1, "Aucun appel d'offres pertinent identifié"), ("", 2, "1 appel d'offres à faible priorité (LOW)"), ("BOAMP", 0, "1 appel d'offres analysé")}


def test_ranked_keeps_ties_in_order(spark):
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, None)], "id int, s int")
    assert {r["id"]: r["position"] for r in report.ranked(rows, "s", "id").collect()} == {2: 1, 1: 2, 3: 3, 4: 4}


def test_minor_amendments_make_new_keys(spark):
    from quillmark.operators import canonical

    flat = "source string, source_id string, uuid_procedure string, title string, acheteur string, deadline string, siret string, raw string, publication_date string"
    stored = canonical.dedup_keys(spark.createDataFrame([("s", "1", None, "T", "B", "2024-01-01", "123", "old", "d"), ("s", "2", None, "U", "B", None, None, "old", "d")], flat)).withColumns({"id": F.col("source_id").cast("int"), "rectification_date": F.lit(None).cast("timestamp"), "rectification_count": F.lit(None).cast("int")})
    minor = spark.createDataFrame([("s", "8", None, "T", "B", "2024-02-01", "123", "first", "2024-01-02", 1), ("s", "9", None, "T", "B", "2024-03-01", "123", "last", "2024-01-03", 1), ("s", "7", None, "X", "B", None, None, "lost", "d", 99)], f"{flat}, original_id int")
    out = {r["id"]: r for r in changes.apply_minor(stored, minor, "2024-01-04T00:00:00Z").collect()}
    assert (out[1]["deadline"], out[1]["raw"], out[1]["composite_key"], out[1]["siret_deadline_key"], out[1]["rectification_count"]) == ("2024-03-01", "last", "t|2024-03-01|b", "123|2024-03-01", 2)
    assert (out[2]["raw"], out[2]["rectification_count"], out[2]["rectification_date"]) == ("old", 0, None) and len(out) == 2


def test_broadcast_sides_are_measured_in_bytes_too(spark, monkeypatch):
    from quillmark.operators import small

    names = spark.createDataFrame([("a", "x" * 50)] * 3, "k string, v string")
    assert small.small(names, "names").count() == 3 and small.small(names.limit(0), "names").count() == 0
    monkeypatch.setattr(small, "MAX_BYTES", 100)
    with pytest.raises(ValueError, match="bytes"):
        small.small(names, "names")
    index = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "id long, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, query array<float>")
    a = retrieval.nearest(queries, index, 2).select("id", "rank").collect()
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 8)
    assert sorted(retrieval.nearest(queries, index, 2).select("id", "rank").collect()) == sorted(a)
