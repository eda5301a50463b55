from __future__ import annotations

import json
import urllib.parse

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThanOrEqual, IsNull

from quillmark import schemas
from quillmark.operators import canonical
from quillmark.operators.lexicon import Lexicon
from quillmark.plans import catalog, daily
from quillmark.sources import files, paged, rss
from quillmark.streaming import approval, ingest


class Remote:
    """A stand-in for the remote interface."""

    def __init__(self, total: int) -> None:
        self.total, self.urls = total, []

    def __call__(self, url: str) -> dict:
        self.urls.append(url)
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(url).query).items()}
        at, n = int(q["offset"]), int(q["limit"])
        return {"total_count": self.total, "results": [{"idweb": f"26-{k}", "type_marche": ["SERVICES"]} for k in range(at, min(self.total, at + n))]}


def test_pages_and_filters():
    remote = Remote(250)
    reader = paged.TenderReader({"path": "http://h/records", "where": "a = 'b'"}, remote)
    left = list(reader.pushFilters([EqualTo(("dateparution",), "2024-01-02"), GreaterThanOrEqual(("dateparution",), "2024-01-01"), IsNull(("titulaire",)), EqualNullSafe(("etat",), "x")]))
    assert [type(f) for f in left] == [EqualNullSafe]
    pages = reader.partitions()
    assert [(p.offset, p.limit) for p in pages] == [(0, 100), (100, 100), (200, 100)]
    rows = [r for p in pages for r in reader.read(p)]
    assert len(rows) == len({r[0] for r in rows}) == 250 and json.loads(rows[0][schemas.RAW_FIELDS.names.index("type_marche")]) == ["SERVICES"]
    where = urllib.parse.parse_qs(urllib.parse.urlparse(remote.urls[-1]).query)["where"][0]
    assert where == "a = 'b' and dateparution = '2024-01-02' and dateparution >= '2024-01-01' and titulaire is null"
    with pytest.raises(ValueError, match="narrow"):
        paged.pages(10_001)


def test_source_registers(spark):
    spark.dataSource.register(paged.TenderSource)
    assert paged.TenderSource({"path": "x"}).schema() == schemas.RAW_FIELDS


def test_rss_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<rss xmlns:dc="http://d"><channel><item><guid>g</guid><title>T</title><description>&lt;p&gt;Nom officiel: V&lt;/p&gt;</description><category>a</category><category>b</category><dc:date>2024-01-02T00:00:00Z</dc:date></item></channel></rss>')
    (tmp_path / "b.xml").write_text("<rss><channel><item><guid>broken")
    rows = rss.items(spark, [str(tmp_path / "a.xml"), str(tmp_path / "b.xml")])
    assert [tuple(r) for r in rows.select("guid", "category", "date").collect()] == [("g", ["a", "b"], "2024-01-02T00:00:00Z")]
    assert canonical.from_rss(rows).first()["tender"]["identity"]["acheteur"] == "V"


def test_json_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "a", "content": "x", "index": "policies"}\n\nnot json\n{"id": "b"}\n')
    assert [r["id"] for r in files.jsonl(spark, str(tmp_path / "c.jsonl")).orderBy("id").collect()] == ["a", "b"]
    assert files.broken_lines(spark, str(tmp_path / "c.jsonl")).count() == 1
    (tmp_path / "d.json").write_text('{"_meta": {}, "clients": [{"nom_normalise": "x", "aliases": ["y"], "statut": "historical"}, {"nom_normalise": "z"}]}')
    assert [(r["ord"], r["nom_normalise"]) for r in files.reference_clients(spark, str(tmp_path / "d.json")).collect()] == [(0, "x"), (1, "z")]
    (tmp_path / "e.json").write_text('[{"id": "1", "ia_correct": true, "decision_expected": "PASS"}, {"id": "2", "ia_correct": "partial"}]')
    assert [r["ia_correct"] for r in files.eval_cases(spark, str(tmp_path / "e.json")).orderBy("id").collect()] == ["true", "partial"]


@pytest.mark.parametrize(("content", "n"), [(None, 0), ("", 0), ("{broken", 0), ('{"jobs": [{"id": "a", "status": "pending"}]}', 1), ('[{"id": "a"}, {"id": "b"}]', 2)])
def test_retry_queue(spark, tmp_path, content, n):
    if content is not None:
        (tmp_path / "q.json").write_text(content)
    assert files.retry_queue(spark, str(tmp_path / "q.json")).count() == n


def test_corpus_rewrite(spark):
    chunks = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, content string")
    parts = spark.createDataFrame([("a", [("a1", "x"), ("a2", "y")])], "id string, parts array<struct<id string, content string>>")
    assert sorted(map(tuple, files.rewrite(chunks, parts).collect())) == [("a1", "x"), ("a2", "y"), ("b", "2")]


def test_streams_are_replay_safe(spark, tmp_path):
    schema = "id long, at timestamp, v long"
    rows = lambda *x: spark.createDataFrame(list(x), "id long, at string, v long").withColumn("at", F.col("at").cast("timestamp"))
    place, source = str(tmp_path / "t"), str(tmp_path / "in")
    rows((1, "2024-01-01", 1), (2, "2024-01-01", 1), (1, "2024-01-01 01:00:00", 2)).coalesce(1).write.parquet(source)
    stream = lambda: ingest.read(spark, source, spark.createDataFrame([], schema).schema)
    ingest.upsert_into(stream(), place, "id", str(tmp_path / "cp"), "at").awaitTermination()
    rows((2, "2024-01-02", 9), (3, "2024-01-02", 3)).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        ingest.upsert_into(stream(), place, "id", str(tmp_path / "cp"), "at").awaitTermination()
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(f"{place}/v=1").collect()) == [(1, 2), (2, 9), (3, 3)]
    ingest.run_daily(stream(), lambda d: d.filter("v > 2"), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_windows(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "k string, v double").withColumn("at", F.lit("2024-01-01 00:10:00").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v double, at timestamp").parquet(str(tmp_path / "in"))
    q = ingest.windowed(stream, "at", "k", "v").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["k"], r["n"], r["total"]) for r in spark.table("windows").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_approval_states(spark, tmp_path):
    events = [("a", 1, "propose"), ("a", 2, "ask"), ("a", 2, "ask"), ("a", 3, "confirm"), ("b", 1, "confirm"), ("b", 2, "propose")]
    spark.createDataFrame(events, "id string, seq long, event string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, seq long, event string").parquet(str(tmp_path / "in"))
    q = approval.states(stream).writeStream.outputMode("append").format("memory").queryName("approvals").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("approvals").collect())) == [("a", 1, "agent_proposed"), ("a", 2, "awaiting_confirm"), ("a", 3, "applied"), ("b", 2, "agent_proposed")]


def test_daily_run(spark):
    def record(i, **x):
        return json.dumps({"idweb": i, "objet": f"Conseil en mobilité {i}", "nomacheteur": "Ville", "dateparution": "2024-01-02", "type_marche": "SERVICES", "datelimitereponse": "2024-04-01", **x})

    read = lambda *r: canonical.from_bulletin(spark.read.schema(schemas.RAW_RECORD).json(spark.sparkContext.parallelize(r)))
    bulletin = read(record("26-10"), record("26-11", nature_libelle="Avis d'annulation"), record("26-12", nature_libelle="Rectificatif", annonce_lie="26-1"), record("26-13", nature_libelle="Rectificatif", annonce_lie="26-404"), record("26-2"))
    feed = canonical.from_rss(spark.createDataFrame([("g1", None, "Conseil en mobilité", "Annonce n° 26-0001", None, None, None, None, None, None, None), ("g2", None, "Conseil en mobilité", "Annonce n° 26-7777", None, None, None, None, None, None, None)], schemas.RSS_ITEM))
    stored = canonical.flatten(read(record("26-1", datelimitereponse="2024-02-01"), record("26-2"), record("26-0001"))).withColumns({"id": F.monotonically_increasing_id(), "status": F.lit("analyzed"), "analyzed_at": F.lit("2024-01-01").cast("timestamp"), "final_score": F.lit(7.0), "priority": F.lit("MEDIUM")})
    lex = Lexicon.of([("sector", "transport", 3, "keyword", "mobilité"), ("expertise", "conseil", 9, "keyword", "conseil")])
    out = {r["source_id"]: r for r in daily.run(bulletin, feed, stored, lex, "2024-03-01").collect()}
    assert {k: r["route"] for k, r in out.items()} == {"26-10": "skip", "26-11": "cancelled", "26-12": "skip", "26-13": "context", "g2": "skip"}
    assert [c["field"] for c in out["26-12"]["changes"]] == ["deadline"] and out["26-12"]["original_id"] is not None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"keyword_score"}))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    out = catalog.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(out.columns)

    def plain(v):
        return round(float(v), 5) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    order = sorted(names)
    a = sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in order]) for r in want.fetchall())
    b = sorted(str([plain(r[c]) for c in order]) for r in out.collect())
    assert a == b


def test_queue_round_trip(spark, tmp_path):
    from quillmark.operators import retry

    path = str(tmp_path / "queue")
    wanted = spark.createDataFrame([("c1", "2024-01-02", "gap"), ("c2", "2024-01-03", None)], "clientId string, date string, reason string")
    files.write_queue(retry.schedule(files.retry_queue(spark, path), wanted, "2024-01-04T00:00:00Z"), path)
    first = files.retry_queue(spark, path)
    assert [(r["clientId"], r["date"], r["reason"], r["status"]) for r in first.orderBy("id").collect()] == [("c1", "2024-01-02", "gap", "pending"), ("c2", "2024-01-03", None, "pending")]
    files.write_queue(retry.settle(first, spark.createDataFrame([(first.orderBy("id").first()["id"], None)], "id string, error string"), "2024-01-05T00:00:00Z"), path)
    assert sorted(r["status"] for r in files.retry_queue(spark, path).collect()) == ["completed", "pending"]
    files.write_queue(files.retry_queue(spark, path).filter("false"), path)
    assert files.retry_queue(spark, path).count() == 0


def test_missing_clients_are_none(spark, tmp_path):
    assert files.reference_clients(spark, str(tmp_path / "none.json")).count() == 0


def test_signed_answers_become_drafts(spark, tmp_path):
    import json

    from quillmark.functions.links import sign
    from quillmark.streaming import answers

    events = [("a1", sign("a1", "k"), " utile "), ("a2", sign("a1", "k"), "faux"), ("a3", sign("a3", "k"), "  "), (None, "x", "y"), ("a4", None, "z")]
    lines = [json.dumps({"source_id": s, "token": t, "feedback": f, "client_id": "c", "at": "2024-01-01T10:00:00Z"}) for s, t, f in events]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join([*lines, "{broken"]))
    query = answers.signed(answers.read(spark, str(tmp_path / "in")), "k").writeStream.format("memory").queryName("signed_answers").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r)[:4] for r in spark.table("signed_answers").collect()] == [("a1", "c", "utile", "draft")]


def test_operations_by_name(spark):
    from quillmark.plans import registry

    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    assert registry.call("delete", base, base.filter("id = 1")).count() == 1
    with pytest.raises(KeyError, match="upsert"):
        registry.call("nothing", base)


class Dated:
    """A stand-in for the remote interface that holds days and gives 10,000 rows of an answer at most."""

    def __init__(self, days: list[str | None]) -> None:
        self.rows = [{"idweb": str(k), "dateparution": d} for k, d in enumerate(days)]

    def __call__(self, url: str) -> dict:
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(url).query).items()}
        rows = self.rows
        for part in q.get("where", "").split(" and ") if q.get("where") else []:
            name, sign, value = part.split(" ", 2)
            value = value.strip("'")
            test = {">=": lambda v, x=value: v is not None and v >= x, "<=": lambda v, x=value: v is not None and v <= x, "is": lambda v, x=value: (v is None) == (x == "null")}[sign]
            rows = [r for r in rows if test(r[name])]
        at, n = int(q["offset"]), int(q["limit"])
        assert at + n <= 10_000 and n <= 100
        rows = sorted(rows, key=lambda r: r["dateparution"] or "", reverse=q["order_by"].endswith("desc"))
        return {"total_count": len(rows), "results": rows[at : at + n]}


def test_more_rows_than_the_interface_gives_are_read_by_ranges_of_days():
    import datetime as dt
    import random

    r = random.Random(1)
    days = [None if r.random() < 0.01 else str(dt.date(2023, 1, 1) + dt.timedelta(days=min(r.randrange(400), r.randrange(400)))) for _ in range(45_000)]
    reader = paged.TenderReader({"path": "http://h/records", "pagesize": "80"}, Dated(days))
    rows = [x for p in reader.partitions() for x in reader.read(p)]
    assert len(rows) == 45_000 and len({x[0] for x in rows}) == 45_000
    with pytest.raises(ValueError, match="2024-01-01"):
        paged.TenderReader({"path": "http://h/records"}, Dated(["2024-01-01"] * 10_001)).partitions()


def test_a_queue_is_replaced_in_one_step(spark, tmp_path):
    """Neither a folder of the older layout nor a run that was cut off loses the jobs."""
    from quillmark.operators import retry

    path = str(tmp_path / "queue")
    wanted = lambda c: spark.createDataFrame([(c, "2024-01-02", "gap")], "clientId string, date string, reason string")
    (tmp_path / "queue").mkdir()
    (tmp_path / "queue" / "part-0").write_text('{"jobs": [{"id": "old", "clientId": "c0", "date": "2024-01-01", "status": "pending"}]}')
    files.write_queue(retry.schedule(files.retry_queue(spark, path), wanted("c1"), "2024-01-04T00:00:00Z"), path)
    assert (tmp_path / "queue").is_file() and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["queue"]
    assert sorted(r["clientId"] for r in files.retry_queue(spark, path).collect()) == ["c0", "c1"]
    files.write_queue(retry.schedule(files.retry_queue(spark, path), wanted("c2"), "2024-01-04T00:00:00Z"), path)
    assert files.retry_queue(spark, path).count() == 3
    (tmp_path / "queue").rename(tmp_path / "queue.old")  # as between the two renames of a change of layout
    assert files.retry_queue(spark, path).count() == 3


def test_only_the_fields_that_are_named_are_fetched():
    remote = Remote(3)
    options = {"path": "http://h/records", "select": "type_marche, idweb"}
    reader = paged.TenderReader(options, remote)
    assert [list(r) for p in reader.partitions() for r in reader.read(p)][0] == ["26-0", '["SERVICES"]']
    assert {urllib.parse.parse_qs(urllib.parse.urlparse(u).query)["select"][0] for u in remote.urls} == {"idweb,type_marche"}
    assert paged.TenderSource(options).schema().names == ["idweb", "type_marche"]
    with pytest.raises(ValueError, match="nothing"):
        paged.selected({"select": "nothing"})
