from __future__ import annotations

import base64
import glob
import gzip
import hashlib

import pytest

from quillmark.llm import warc

SCHEMA = "page_id long, url string, html string, archive string"
ROWS = [(1, "http://a/", "<p>é</p>", "x"), (2, "http://b/\r\nX: y", "<p>é</p>", "x"), (3, None, None, None), (4, "u", "", "x"), (5, "u", "z" * 300_000, "x"), (9, "u", "<p>é</p>", "x"), (9, "u", "<p>é</p>", "x"), (None, "u", "alone", "x"), (None, "u", "", "x")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    rows = warc.read_archives(warc.write_archives(pages), payloads=True).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        htmls = {h or "" for p, _, h, _ in ROWS if p == r["page_id"]}
        data = next(h.encode() for h in htmls if base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() == r["payload_digest"])
        assert r["payload_bytes"] == len(data) and (r["payload"] == data if r["record_type"] == "response" else r["payload"] is None)
    kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in rows if r["page_id"] or r["payload_bytes"])
    assert [k for k in kinds if k[0] > 0] == [(1, "revisit", 9), (2, "revisit", 9), (3, "revisit", 4), (4, "response", None), (5, "response", None), (9, "response", None), (9, "response", None)]
    assert [(r["record_type"], r["refers_to"]) for r in rows if r["page_id"] is None and not r["payload_bytes"]] == [("revisit", 4)]


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], SCHEMA))).collect() == []


def test_one_member_a_record_and_files(spark, tmp_path):
    archives = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(1))
    assert warc.export(archives, str(tmp_path)) == len(glob.glob(f"{tmp_path}/*.warc.gz")) == 1
    data = open(glob.glob(f"{tmp_path}/*")[0], "rb").read()
    assert len(list(warc.members(data))) == len(ROWS) and gzip.decompress(data) == b"".join(warc.members(data))


def test_damage_is_noticed():
    record = warc.write_record(1, "u", b"payload", None, "1970-01-01T00:00:00Z")
    content = next(warc.members(record))
    assert warc.read_record(content)["payload"] == b"payload"
    for bad in (content.replace(b"payload\r\n", b"pAyload\r\n"), content[:-2], content.replace(b"WARC/1.1", b"JUNK/1.1"), content.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(warc.WarcError):
            warc.read_record(bad)
    for bad in (record[:-5], b"junk" + record):
        with pytest.raises(warc.WarcError):
            list(warc.members(bad))


def test_null_empty_and_repeated_archives(spark):
    one = warc.write_archives(spark.createDataFrame(ROWS[:1], SCHEMA)).first()["archive"]
    archives = spark.createDataFrame([(bytearray(b""),), (None,), (one,), (one,)], "archive binary")
    assert [r["page_id"] for r in warc.read_archives(archives).collect()] == [1, 1]


def test_a_bad_archive_ends_the_job(spark):
    one = warc.write_archives(spark.createDataFrame(ROWS[:1], SCHEMA)).first()["archive"]
    with pytest.raises(Exception, match="WarcError"):
        warc.read_archives(spark.createDataFrame([(one[:-4],)], "archive binary")).collect()


def test_damage_becomes_rows_and_reading_goes_on(spark):
    parts = [warc.write_record(k, "u", b"payload %d" % k * 40, None, "1970-01-01T00:00:00Z") for k in range(5)]
    broken = bytearray(parts[1])
    broken[len(broken) // 2] ^= 255
    lying = gzip.compress(next(warc.members(parts[3])).replace(b"payload 3", b"payload 4"))
    archives = spark.createDataFrame([(bytearray(parts[0] + bytes(broken) + parts[2] + lying + parts[4][:-3]),), (bytearray(b"junk" + parts[4]),)], "archive binary")
    rows = warc.read_archives(archives, payloads=True, errors=True).collect()
    assert sorted(r["page_id"] for r in rows if r["error"] is None) == [0, 2, 4]
    assert all(r["payload"] for r in rows if r["error"] is None)
    assert sum(r["error"] is not None for r in rows) == 4 and all(r["page_id"] is None for r in rows if r["error"])
    whole = warc.read_archives(warc.write_archives(spark.createDataFrame(ROWS, SCHEMA)), errors=True)
    assert whole.count() == len(ROWS) and whole.filter("error is not null").count() == 0
