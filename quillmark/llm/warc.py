"""WARC archives: a writer that replaces repeated payloads by revisit records, and a sequential reader.

An archive is a byte string with one gzip member for each record, as ``.warc.gz`` files have it.  On a
cluster archives travel as a binary column, so that Spark's own writers put them where all executors see
them; ``export`` writes them out as files where a folder is mounted.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import lean

#: An archive ends before it would hold more than this.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 512, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
CHUNK = 1 << 16
_MAGIC = b"\x1f\x8b\x08"


class WarcError(ValueError):
    """An archive that does not follow the format, or whose digest does not fit."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page}')}>"


def _clean(value: str) -> str:
    """A header value has no line ends."""
    return re.sub(r"[\r\n\x00]", lambda m: f"%{ord(m[0]):02X}", value)


def write_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member. With refers_to it is a revisit, whose block ends after the HTTP headers."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _member(rest: memoryview) -> tuple[bytes, int]:
    """The content of the gzip member at the front, inflated step by step, and its length."""
    inflate, parts, used = zlib.decompressobj(31), [], 0
    while not inflate.eof:
        if used >= len(rest):
            raise WarcError("a gzip member does not end")
        piece = rest[used : used + CHUNK]
        try:
            parts.append(inflate.decompress(piece))
        except zlib.error as e:
            raise WarcError(f"bad gzip data: {e}") from e
        used += len(piece)
    return b"".join(parts), used - len(inflate.unused_data)


def members(data: bytes | memoryview, recover: bool = False) -> Iterator[bytes | WarcError]:
    """The content of each gzip member. Damage is raised, or with ``recover`` yielded once, after which reading goes on at the next member that inflates."""
    raw, at, damaged = bytes(data), 0, False
    while 0 <= at < len(raw):
        try:
            content, size = _member(memoryview(raw)[at:])
        except WarcError as e:
            if not recover:
                raise
            if not damaged:
                yield e
            at, damaged = raw.find(_MAGIC, at + 1), True
            continue
        at, damaged = at + size, False
        yield content


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-cased name, and the block as framed by Content-Length; digests are checked."""
    end = content.find(b"\r\n\r\n")
    if end < 0 or not content.startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    headers = {}
    for line in content[:end].decode().split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"bad header line {line!r}")
        headers[name.strip().lower()] = value.strip()
    length = int(headers.get("content-length", -1))
    block = content[end + 4 : end + 4 + length]
    if length < 0 or len(block) != length or content[end + 4 + length :] != b"\r\n\r\n":
        raise WarcError("Content-Length does not fit the record")
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{digest_of(block)}":
        raise WarcError("block digest does not fit")
    return headers, block


def read_record(content: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes, payload_digest."""
    headers, block = parse(content)
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no HTTP header")
    length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = headers.get("warc-type")
    if kind == "response" and (digest != digest_of(payload) or (length and int(length[1]) != len(payload))):
        raise WarcError("payload digest does not fit")
    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
    return {"page_id": None if page is None else int(page), "url": headers.get("warc-target-uri"), "record_type": kind, "refers_to": None if refers is None else int(refers), "payload": payload if kind == "response" else None, "payload_bytes": int(length[1]) if length else len(payload), "payload_digest": digest}


def with_revisits(pages: DataFrame, minimum: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: for pages whose payload equals that of a page with a larger id.

    Only digests are grouped, so a payload that a third of all pages have costs its group one row for each
    task; neither side of the join on digests is aggregated in its stage, nor is its result, so that a hot digest can be split. Pages that share the largest id of a group are all responses; a page with a null id refers to
    the largest id there is.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    digests = base.filter(F.octet_length("html") >= minimum).select("page_id", "digest").distinct()
    winners = digests.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col("winner").isNotNull())
    revisits = digests.join(winners, "digest").filter(~F.col("page_id").eqNullSafe(F.col("winner"))).select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), F.col("winner").alias("refers_to"))
    return base.join(revisits, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", minimum: int = 0) -> DataFrame:
    """(n_records, archive): WARC archives of bounded size; one record for each row of pages.

    A null html is an empty payload; a null id or url stays null. Rows that repeat are records of their own. A payload of any size is one record, which may
    be an archive by itself. No pages give no archives. Columns other than page_id, url and html are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([len(records)], pa.int32()), pa.array([b"".join(records)], pa.binary())], ["n_records", "archive"])
            records.clear()
            return out

        for batch in batches:
            for page, url, html, refers in zip(*(c for c in batch.columns), strict=True):
                member = write_record(page.as_py(), url.as_py(), html.as_py().encode(), refers.as_py(), date)
                if records and (len(records) >= ARCHIVE_RECORDS or size + len(member) > ARCHIVE_BYTES):
                    yield flush()
                    size = 0
                records.append(member)
                size += len(member)
        if records:
            yield flush()

    return with_revisits(pages, minimum).mapInArrow(lean(run), "n_records int, archive binary")


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, payloads: bool = False, errors: bool = False) -> DataFrame:
    """The records of archives; with ``payloads`` also the bytes of responses (of revisits: null).

    Archives may hold any number of records and repeat; an empty or null archive has none. A member that cannot be inflated, a block that
    is shorter than its Content-Length, and a digest that does not fit are a WarcError, which ends the job: none is skipped. With
    ``errors`` each is a row instead, null but for its last column ``error``, and reading goes on at the next member; records that are
    whole have a null there. Damage over several members is one row.
    """
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")] + ["payload"] * payloads + ["error"] * errors
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads + [pa.string()] * errors

    def read(content: bytes | WarcError) -> dict:
        if not errors:
            return read_record(content)
        try:
            if isinstance(content, WarcError):
                raise content
            return read_record(content)
        except ValueError as e:  # WarcError, and numbers or text that are none
            return {"error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for content in members(archive.as_buffer() if archive.is_valid else b"", recover=errors):
                    row = read(content)
                    rows.append([row.get(x) for x in names])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("archive").mapInArrow(lean(run), READ_SCHEMA + ", payload binary" * payloads + ", error string" * errors)


def export(archives: DataFrame, folder: str) -> int:
    """Writes ``.warc.gz`` files into a folder that all executors mount; returns their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for archive in batch.column(0):
                data = archive.as_py()
                name = f"{folder}/{hashlib.sha1(data).hexdigest()}.warc.gz"
                with open(part := f"{name}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data)
                os.replace(part, name)
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return archives.select("archive").mapInArrow(lean(run), "name string").count()
