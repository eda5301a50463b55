"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, hmm, jaccard, licenses, linededup, media, packing, patterns, pii, resample, suffix, toxicity, warc
from quillmark.llm.common import checkpointed, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items in documents, with other parameters too."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without recurring lines."""
    return linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a hidden Markov model."""
    return hmm.score(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned outside fold 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through WARC archives in the shared folder and back."""
    archives = checkpointed(warc.write_archives(table(spark, sf_dir, "pages")))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without byte strings that occur earlier."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their shingles."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a JPEG media column and back."""
    return media.media_column(table(spark, sf_dir, "documents"))


def op11_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of clicks of each client that rise and fall up to a view."""
    found = patterns.match_rows(table(spark, sf_dir, "clicks"))
    return found.withColumn("labels_sha256", F.sha2("labels", 256)).drop("labels")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's distribution of words."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_linededup": op4_linededup,
    "op5_hmm": op5_hmm,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_suffix": op8_suffix,
    "op9_jaccard": op9_jaccard,
    "op10_media": op10_media,
    "op11_patterns": op11_patterns,
    "op12_licenses": op12_licenses,
    "op13_resample": op13_resample,
}

ORACLES: dict[str, str] = {
    "op9_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingle a JOIN shingle b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(doc, id) AS (
  SELECT DISTINCT a, a FROM edge UNION SELECT edge.b, reach.id FROM reach JOIN edge ON reach.doc = edge.a
), least AS (
  SELECT doc, min(id) AS id FROM reach GROUP BY doc
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least.id, d.doc_id) AS component_id
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN least ON least.doc = d.doc_id
""",
    "op4_linededup": linededup.ORACLE,
    "op11_patterns": patterns.ORACLE,
    "op12_licenses": licenses.oracle(),
    "op13_resample": resample.ORACLE,
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT h, max(page_id) AS winner FROM p GROUP BY h),
d AS (SELECT p.page_id, strlen(p.html) AS n, p.h, w.winner FROM p JOIN w USING (h))
SELECT page_id,
  CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)), lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM d
""",
}
