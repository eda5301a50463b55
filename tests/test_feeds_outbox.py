from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from quillmark.operators import canonical
from quillmark.sources import feeds, outbox

XML = '<rss xmlns:dc="http://d"><channel><title>feed</title><item><guid>{g}</guid><title>T</title><description>&lt;p&gt;Nom officiel: V&lt;/p&gt;</description><category>a</category><category>b</category><dc:date>2024-01-02T00:00:00Z</dc:date></item><item><guid>{g}2</guid></item></channel></rss>'


@pytest.fixture
def urls(tmp_path):
    (tmp_path / "a.xml").write_text(XML.format(g="g"))
    (tmp_path / "b.xml").write_text("<rss><channel><item><guid>broken")
    (tmp_path / "e.xml").write_text("<rss><channel/></rss>")
    return [f"file://{tmp_path}/{n}.xml" for n in ("a", "b", "missing", "e")]


def test_feeds_that_fail_are_told(spark, urls):
    spark.dataSource.register(feeds.FeedSource)
    rows = spark.read.format("feeds").option("urls", json.dumps(urls)).option("pause", 0).load()
    assert [tuple(r) for r in feeds.items(rows).select("guid", "category", "date").orderBy("guid").collect()] == [("g", ["a", "b"], "2024-01-02T00:00:00Z"), ("g2", None, None)]
    bad = {os.path.basename(r["feed"]): r["error"].split(":")[0] for r in feeds.failures(rows).collect()}
    assert bad == {"b.xml": "ParseError", "missing.xml": "URLError"}
    assert canonical.from_rss(feeds.items(rows).filter("guid = 'g'")).first()["tender"]["identity"]["acheteur"] == "V"


def test_a_stream_of_polls(spark, urls, tmp_path, monkeypatch):
    spark.dataSource.register(feeds.FeedSource)
    def poll():
        stream = spark.readStream.format("feeds").option("urls", json.dumps(urls)).option("pause", 0).option("interval", 1e10).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    poll()
    poll()  # the same poll again: it is in the checkpoint
    rows = spark.read.schema(feeds.SCHEMA).parquet(str(tmp_path / "out"))
    assert feeds.items(rows).count() == 2 and feeds.failures(rows).count() == 2
    reader = feeds.FeedStream({"urls": json.dumps(urls), "interval": "10"})
    monkeypatch.setattr(feeds.time, "time", lambda: 105.0)
    assert reader.initialOffset() == {"poll": 9} and reader.latestOffset() == {"poll": 10}
    assert [p.poll for p in reader.partitions({"poll": 3}, {"poll": 10})] == [10] * 4 and reader.partitions({"poll": 10}, {"poll": 10}) == []


def mails(spark, *rows):
    return spark.createDataFrame(list(rows), outbox.SCHEMA)


def test_mails_are_there_once_or_not_at_all(spark, tmp_path):
    spark.dataSource.register(outbox.Outbox)
    folder = str(tmp_path / "box")
    say = lambda df: df.write.format("outbox").mode("append").save(folder)
    two = mails(spark, ("a@x", "s", "<p>é</p>", None), ("b@x", "s", None, "t"))
    say(two.repartition(2))
    say(two)  # a job that is run again
    names = sorted(os.listdir(f"{folder}/new"))
    assert len(names) == 2 and json.loads((tmp_path / "box" / "new" / names[0]).read_text())["subject"] == "s"
    (tmp_path / "box" / "sent").mkdir()
    os.replace(f"{folder}/new/{names[0]}", f"{folder}/sent/{names[0]}")
    say(two)  # what was sent does not come back
    assert os.listdir(f"{folder}/new") == names[1:]
    bad = spark.range(40).select(F.when(F.col("id") < 39, F.concat("id", F.lit("@x"))).alias("recipient"), F.lit("s").alias("subject"), F.lit("h").alias("html"), F.lit("t").alias("text"))
    with pytest.raises(Exception, match="recipient"):
        say(bad.repartition(4))
    assert os.listdir(f"{folder}/new") == names[1:] and [n for n in os.listdir(folder) if n.startswith(".")] == []
    with pytest.raises(Exception, match="appended"):
        two.write.format("outbox").mode("overwrite").save(folder)
