"""Search: nearest vectors under a filter, and known names in free spellings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text
from quillmark.operators import matching

#: A side is sent to all tasks up to so many rows and bytes; above, the join is by blocks.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20
#: Rows of one packed block of vectors, and scores that are held at once.
PACKED, SCORES = 4096, 1 << 21
#: Scores count with so many digits; sums in another order differ beyond them.
DIGITS = 9
# Fixed thresholds of name matching.
LEAST_OVERLAP, SUBSTRING, SUBSTRING_LONGER_THAN = 0.6, 0.95, 4
# End of the fixed thresholds.


def _pack(rows: DataFrame, key: str, vector: str, same: list[str]) -> DataFrame:
    """same..., ids, size, data: vectors of a size as one row of doubles for each piece of an Arrow batch and each value of the columns ``same``.

    Vectors that are null or hold a null have no score; their size is -1.
    """
    plain = rows.select(*same, F.col(key).alias("_id"), F.when(~F.exists(vector, lambda v: v.isNull()), F.col(vector).cast("array<double>")).alias("_vector"))
    fields = plain.schema.fields
    shape = T.StructType([*fields[: len(same)], T.StructField("ids", T.ArrayType(fields[-2].dataType)), T.StructField("size", T.IntegerType()), T.StructField("data", T.BinaryType())])
    columns = [*same, "ids", "size", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, PACKED):
                batch = whole.slice(first, PACKED)
                sizes = batch.column(len(same) + 1).value_lengths().fill_null(-1)
                table = pa.table([*batch.columns[: len(same)], sizes, pa.array(range(batch.num_rows))], [*same, "size", "at"])
                for group in table.group_by([*same, "size"], use_threads=False).aggregate([("at", "list")]).to_pylist():
                    at = pa.array(group["at_list"])
                    own = batch.take(at)
                    data = b"" if group["size"] < 0 else own.column(len(same) + 1).flatten().to_numpy(zero_copy_only=False).tobytes()
                    ids = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), own.column(len(same)))
                    keys = [c.slice(0, 1) for c in own.columns[: len(same)]]
                    yield pa.RecordBatch.from_arrays([*keys, ids, pa.array([group["size"]], pa.int32()), pa.array([data], pa.binary())], columns)

    return plain.mapInArrow(run, shape)


def _best(q: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (query, row) and scores of the k best rows of each query; of equal scores the first row's. Nulls are -inf and come last, not-a-number first."""
    with np.errstate(all="ignore"):
        norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((m * m).sum(axis=1))[None, :]
        rough = (q @ m.T) / norms
        rough[np.isnan(rough)] = np.inf
        rough[norms == 0] = -np.inf
        most = min(k, len(m))
        least = np.partition(rough, len(m) - most, axis=1)[:, len(m) - most]
        a, b = np.nonzero(rough >= least[:, None] - 2 * 10.0**-DIGITS)
        step = max(1, SCORES // q.shape[1])  # equal scores may be many
        dots = [(q[a[s : s + step]] * m[b[s : s + step]]).sum(axis=1) for s in range(0, len(a), step)]
        exact = np.concatenate([*dots, np.zeros(0)]) / norms[a, b] * 10.0**DIGITS
        score = np.copysign(np.floor(np.abs(exact) + 0.5), exact) / 10.0**DIGITS
    key = np.where(norms[a, b] == 0, -np.inf, np.where(np.isnan(score), np.inf, score))
    order = np.lexsort((b, -key, a))
    a, b, key = a[order], b[order], key[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], key[keep]


def nearest(queries: DataFrame, index: DataFrame, k: int, same: list[str] | None = None, blocks: int = 16) -> DataFrame:
    """(query_id, id, score, rank): for each query the k nearest rows by cosine, rounded to ``DIGITS`` digits; ties by id.

    queries: query_id, query; index: id, vector. ``same`` names columns of both that must be equal: the filter comes before
    the top k, as an equi-join. Both sides are packed into blocks where they are read. Few queries go to all tasks, so the index stays where it is;
    else it is dealt into ``blocks`` parts that all queries meet. A pair of blocks is one product of matrices and gives the k best of each
    query, which is exact after a second top k. Pairs without a cosine come last and have no score.
    """
    same = same or []
    n, numbers = queries.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("query"), F.lit(0))), F.lit(0))).first()
    asked = _pack(queries, "query_id", "query", same).withColumnsRenamed({"ids": "_ids", "size": "_size", "data": "_data"})
    held = _pack(index, "id", "vector", same)
    if n <= BROADCAST_ROWS and 8 * numbers <= BROADCAST_BYTES:
        pairs = held.join(F.broadcast(asked), same) if same else held.join(F.broadcast(asked), F.lit(True))
    else:
        dealt = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = held.withColumn("_block", F.pmod(F.xxhash64("ids"), F.lit(blocks)).cast("int")).join(dealt.hint("merge"), [*same, "_block"])
    kinds = [d.schema[c].dataType for d, c in ((queries, "query_id"), (index, "id"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                asks, ids, sizes = batch.column(0)[r].values, batch.column(3)[r].values, (batch.column(1)[r].as_py(), batch.column(4)[r].as_py())
                turn = pa.compute.sort_indices(ids)  # places are in the order of ids
                ids = ids.take(turn)
                width = sizes[0] if sizes[0] == sizes[1] and sizes[0] > 0 else 0  # of other sizes: no score
                read = lambda c, n: np.frombuffer(batch.column(c)[r].as_py(), dtype=float).reshape(n, width) if width else np.zeros((n, 1))  # noqa: E731, B023
                q, m = read(2, len(asks)), read(5, len(ids))[turn.to_numpy()]
                step = max(1, SCORES // max(1, len(ids)))
                for first in range(0, len(asks), step):
                    a, b, score = _best(q[first : first + step], m, k)
                    score = pa.array(np.where(score == np.inf, np.nan, score), mask=score == -np.inf)
                    yield pa.RecordBatch.from_arrays([asks.take(pa.array(a + first)), ids.take(pa.array(b)), score], ["query_id", "id", "score"])

    shape = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("id", kinds[1]), T.StructField("score", T.DoubleType())])
    scored = pairs.select("_ids", "_size", "_data", "ids", "size", "data").mapInArrow(run, shape)
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))).filter(F.col("rank") <= k)


def known_buyer(buyers: DataFrame, clients: DataFrame) -> DataFrame:
    """buyer, and the best known client: nom_normalise, match_type, match_score, match_confidence; null without any.

    clients: nom_normalise, aliases, statut, and ord, their order (without it they are in the order of names). Exact spellings count 1, a client's name inside the buyer's 0.95, common tokens 0.7 plus 0.2
    of their share from 0.6 on; the first best in the order of clients and aliases counts. Each way has its index: spellings are
    joined, names within names meet by their rarest gram, token sets by their rarest tokens. Both sides may be of any size; equal
    spellings and equal token sets meet once.
    """
    turn = F.col("ord") if "ord" in clients.columns else F.col("nom_normalise")
    names = clients.select("nom_normalise", turn.alias("_client"), F.posexplode(F.concat(F.array("nom_normalise"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_alias", "_name"))
    names = names.withColumns({"_plain": text.normalize_words(F.col("_name")), "_tokens": F.array_sort(text.long_tokens(F.col("_name")))}).withColumn("_set", F.array_join("_tokens", " "))
    place = F.struct("_client", "_alias")
    first = lambda *keys: names.groupBy(*keys).agg(F.min_by(F.struct("nom_normalise", "_client", "_alias"), place).alias("_who"))  # noqa: E731  one row for each spelling
    spelled, sets = first("_plain"), first("_set")
    own = buyers.select("buyer").distinct().withColumns({"_buyer": text.normalize_words(F.col("buyer")), "_tokens": F.array_sort(text.long_tokens(F.col("buyer")))}).filter(F.col("_buyer") != "").withColumn("_own", F.array_join("_tokens", " "))

    exact = own.join(spelled, own["_buyer"] == spelled["_plain"]).select("buyer", "_who", F.lit(1.0).alias("_score"), F.lit("exact").alias("_kind"))
    longer = spelled.filter(F.length("_plain") > SUBSTRING_LONGER_THAN)
    inside = matching.contained(longer.select(F.col("_plain").alias("needle")), own.select(F.col("_buyer").alias("text"))).filter("needle <> text")
    inside = inside.join(longer, inside["needle"] == longer["_plain"]).groupBy("text").agg(F.min_by("_who", F.struct("_who._client", "_who._alias")).alias("_who"))
    inside = own.join(inside, own["_buyer"] == inside["text"]).select("buyer", "_who", F.lit(SUBSTRING).alias("_score"), F.lit("substring").alias("_kind"))
    tokens = lambda df, key, name: df.select(F.col(key).alias(name), F.split(key, " ").alias("tokens")).filter(F.col(name) != "").distinct()
    alike = matching.overlapping(tokens(own, "_own", "a"), tokens(sets, "_set", "b"), LEAST_OVERLAP)
    alike = alike.join(sets, alike["b"] == sets["_set"]).groupBy("a").agg(F.min_by(F.struct("_who", "share"), F.struct(-F.col("share"), F.col("_who._client"), F.col("_who._alias"))).alias("_best"))
    alike = own.join(alike, own["_own"] == alike["a"]).select("buyer", F.col("_best._who").alias("_who"), (0.7 + F.col("_best.share") * 0.2).alias("_score"), F.lit("fuzzy").alias("_kind"))

    hits = exact.unionByName(inside).unionByName(alike)
    best = hits.groupBy("buyer").agg(F.min_by(F.struct("_who", "_kind", "_score"), F.struct(-F.col("_score"), F.col("_who._client"), F.col("_who._alias"))).alias("_best"))
    found = buyers.join(best, "buyer", "left")
    value = F.col("_best._score")
    return found.select(*buyers.columns, F.col("_best._who.nom_normalise").alias("nom_normalise"), F.col("_best._kind").alias("match_type"), F.round(value, 2).alias("match_score"), F.when(value > 0.9, "HIGH").when(value > 0.75, "MEDIUM").when(value.isNotNull(), "LOW").alias("match_confidence"))
