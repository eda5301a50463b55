"""Importance resampling towards a target distribution.

1. Identical texts are collapsed: one row for each full text, with its number of copies.
2. The features of a text (runs of words) are hashed into buckets once, and kept as one packed array for each text.
3. Bucket counts of the corpus are sums over these arrays, times copies; those of the target come the same way. Both are
   added up on the executors; ``buckets`` numbers, a parameter, reach the driver.
4. A bucket's gain is the scaled logarithm of its smoothed shares; a text's weight is the sum of gains of its features.
5. Weights go back to documents by a digest of the text (SHA-256); one text may have a third of all documents, so the
   join has that side unaggregated and can be split. Only then comes the noise, which belongs to the document.
6. Documents are dealt by ranges of score and numbered within their range; ranges before are added up.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import checkpointed, discard, lean
from quillmark.llm.words import pieces, texts

BUCKETS, LONGEST = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Words whose bucket a task remembers.
REMEMBERED = 1 << 19


class Hasher(dict):
    """Buckets of words, remembered up to a number."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = k = zlib.crc32(word) % self.buckets
        return k


def bucketed(text: bytes, hasher: Hasher, longest: int) -> np.ndarray:
    """The bucket of each run of 1 to longest words."""
    found, last = [], []
    for words in pieces(text):
        found.append(np.fromiter(map(hasher.__getitem__, words), dtype=np.uint32, count=len(words)))
        if longest > 1:
            both = last + words  # runs that begin in the piece before are taken where they end
            for k in range(2, longest + 1):
                ends = range(max(k, len(last) + 1), len(both) + 1)
                found.append(np.fromiter((hasher[b" ".join(both[e - k : e])] for e in ends), dtype=np.uint32, count=len(ends)))
            last = both[-(longest - 1) :]
    return np.concatenate([*found, np.zeros(0, np.uint32)])


_FEATURES = pa.schema([("digest", pa.binary()), ("copies", pa.int64()), ("packed", pa.binary())])
_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
_WEIGHTS = pa.schema([("digest", pa.binary()), ("n_features", pa.int64()), ("weight", pa.int64())])


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _digest(column: Column) -> Column:
    return F.unhex(F.sha2(column, 256))


def collapsed(docs: DataFrame, text: str, buckets: int, longest: int) -> DataFrame:
    """digest, copies, packed buckets of each distinct text; null is an empty text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets)
        for batch in batches:
            packed = [bucketed(value, hasher, longest).tobytes() for value in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(packed, pa.binary())], schema=_FEATURES)

    distinct = docs.groupBy(_text(text).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    return distinct.select("text", _digest(F.col("text")).alias("digest"), "copies").mapInArrow(run, "digest binary, copies long, packed binary")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs, copies counted."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for copies, packed in zip(batch.column("copies").to_pylist(), batch.column("packed"), strict=True):
                total += copies * np.bincount(np.frombuffer(packed.as_buffer() or b"", dtype=np.uint32), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], schema=_COUNTS)

    total = np.zeros(buckets, dtype=np.int64)
    for r in features.select("copies", "packed").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of smoothed shares, for each bucket."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(p.as_buffer() or b"", dtype=np.uint32) for p in batch.column("packed")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([len(x) for x in found], pa.int64()), pa.array([int(gain[x].sum()) for x in found], pa.int64())], schema=_WEIGHTS)

    return features.select("digest", "packed").mapInArrow(run, "digest binary, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) with u from a hash of the seed and the document."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """key, n_features, weight, score, rank of every row; the drawn have ranks 1, 2, 3..., the others null.

    Drawn is that percentage (rounded down) of the rows with at least least_words features, by descending score; ties go to the smaller
    key, null keys last. A null or empty text has no features and weight 0. Rows that repeat key and text have equal scores
    and stand one behind the other. With an empty target gains compare with equal shares. Other columns are not read, so
    their names cannot clash. An empty table gives an empty one.
    """
    features = checkpointed(collapsed(docs, text, buckets, longest))
    aimed = checkpointed(collapsed(target, text, buckets, longest))
    gain = gains(bucket_counts(features, buckets), bucket_counts(aimed, buckets))
    known = checkpointed(weights(features, gain))
    discard(features, aimed)
    own = docs.select(F.col(key).alias("key"), _digest(_text(text)).alias("digest"))
    scored = own.join(known, "digest").select("key", "n_features", "weight", (F.col("weight") + noise(F.col("key"), seed)).cast("long").alias("score"), (F.col("n_features") >= least_words).alias("able"))
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("key")]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    dealt = checkpointed(dealt)
    discard(known)
    counts = sorted(map(tuple, dealt.filter("able").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()))  # one number a partition
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    shifts = docs.sparkSession.createDataFrame(before, "part int, shift long")
    place = F.col("shift") + F.col("at") + 1
    rank = F.when(F.col("able") & (place <= F.lit(percent * total // 100)), place)
    return dealt.join(F.broadcast(shifts), "part", "left").select(F.col("key").alias(key), "n_features", "weight", "score", rank.alias("rank"))


#: The same rows in SQL, with the checksum byte by byte from its table.
ORACLE = r"""
WITH RECURSIVE step(i, v, k) AS (
  SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY i) AS crc FROM step WHERE k = 8
), d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), word AS (
  SELECT r, unnest(w) AS word FROM d
), aim AS (
  SELECT unnest(w) AS word FROM b
), name AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM word UNION SELECT word FROM aim)
), bucket AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(h) // 2), lambda k: CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM name, crc
), s AS (
  SELECT bucket, count(*) AS s FROM word JOIN bucket USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM aim JOIN bucket USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM word) + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM aim) + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)
), weighed AS (
  SELECT r, sum(gain) AS weight FROM word JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, d.r, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (r)
), placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""
