"""An inverted file of vectors: k-means cells, scanned cell by cell in numpy blocks, with bounds that make the top k exact.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors by a hash of the id, ``ROUNDS`` rounds of Lloyd's algorithm on unit vectors); every vector is
assigned. A cell knows the widest angle between its centroid and a member, so by the triangle inequality of angles no member
is nearer to a query than the angle to the centroid less that width. A query probes its nearest cells first; each further cell whose
bound reaches the k-th score that it has by then is probed too, so nothing is missed whatever the cells are like.

Vectors of a cell and the queries that probe it meet as packed blocks of bounded size; a cell with many vectors has many blocks,
so no cell goes through one task. Cells (their number is a parameter) are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.operators.lineage import checkpointed

#: Vectors that centroids are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 16_384, 8
#: Vectors and queries of one block.
BLOCK, ASKING = 1024, 256
#: Scores are compared with this much room, as sums in another order differ in their last digits.
ROOM = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row without length stays 0."""
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None]


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of at most that many cells; always the same for the same rows."""
    unit = _unit(sample)
    unit = np.unique(unit[(unit * unit).sum(axis=1) > 0], axis=0)
    if len(unit) <= cells:
        return unit
    centres = unit[np.random.Generator(np.random.PCG64(7)).choice(len(unit), cells, replace=False)]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, unit)
        empty = np.bincount(own, minlength=len(centres)) == 0
        centres = np.where(empty[:, None], centres, _unit(total))
    return centres


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, and which of them can be compared: those of the right size, without nulls, with a length."""
    rows, good = np.zeros((len(column), size)), np.zeros(len(column), dtype=bool)
    for k, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == size and None not in v:
            rows[k] = v
            good[k] = np.isfinite(rows[k]).all() and bool(rows[k].any())
    rows[~good] = 0
    return rows, good


@dataclass
class VectorIndex:
    """rows: cell, block, ids, packed (unit vectors), checkpointed; count and width of each cell."""

    rows: DataFrame
    centres: np.ndarray
    counts: np.ndarray
    widths: np.ndarray
    id_type: str

    @staticmethod
    def build(index: DataFrame, cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> VectorIndex:
        """Of index (id, vector). Vectors that are null, of another size than most of the sample, or without length are in no result, as they have no cosine."""
        n = index.count()
        drawn = index.filter(F.shiftrightunsigned(F.xxhash64("id"), 33) < min(1 << 31, 4 * sample * (1 << 31) // max(1, n) + 1)).filter("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector")
        vectors = [v for (v,) in drawn.collect() if v and None not in v]
        sizes = np.bincount([len(v) for v in vectors]) if vectors else np.zeros(1, dtype=int)
        size = int(sizes.argmax())
        cells = cells or max(1, min(4096, int(np.sqrt(n))))
        centres = fit(np.array([v for v in vectors if len(v) == size], dtype=float).reshape(-1, size), cells) if size else np.zeros((0, 0))
        kind = index.schema["id"].dataType.simpleString()

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, good = _matrix(batch.column(1), size)
                good &= len(centres) > 0
                unit = _unit(rows[good])
                near = unit @ centres.T if good.any() else np.zeros((0, 1))
                own = near.argmax(axis=1) if len(near) else np.zeros(0, dtype=int)
                angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(own.astype(np.int32)), pa.array(angle), pa.array([u.tobytes() for u in unit], pa.binary())], ["id", "cell", "angle", "unit"])

        placed = checkpointed(index.select("id", "vector").mapInArrow(assign, f"id {kind}, cell int, angle double, unit binary"))
        known = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("width")).collect()  # a row for each cell
        counts, widths = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
        for r in known:
            counts[r["cell"]], widths[r["cell"]] = r["n"], r["width"]
        parts = F.element_at(F.array(*(F.lit(int(-(-c // block) or 1)) for c in counts.tolist())), F.col("cell") + 1) if len(counts) else F.lit(1)
        dealt = placed.withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int"))
        packed = dealt.groupBy("cell", "block").agg(F.sort_array(F.collect_list(F.struct("id", "unit"))).alias("rows"))  # about BLOCK rows
        return VectorIndex(checkpointed(packed.select("cell", "block", F.col("rows.id").alias("ids"), F.col("rows.unit").alias("units"))), centres, counts, widths, kind)

    def _probe(self, queries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score): the k best of each block that a query meets; asked has query_id, unit, cell."""
        size = self.centres.shape[1]
        turn = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // ASKING)))).cast("int")
        asking = asked.groupBy("cell", turn.alias("turn")).agg(F.collect_list(F.struct("query_id", "unit")).alias("queries"))
        met = asking.join(self.rows, "cell").select("queries", "ids", "units")
        kind = queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    asked_, ids = batch.column(0)[row].values, batch.column(1)[row].values
                    matrix = np.frombuffer(b"".join(batch.column(2)[row].as_py()), dtype=float).reshape(-1, size)
                    q = np.frombuffer(b"".join(asked_.field("unit").to_pylist()), dtype=float).reshape(-1, size)
                    rough = q @ matrix.T
                    most = min(k, len(matrix))
                    least = np.partition(rough, len(matrix) - most, axis=1)[:, len(matrix) - most]
                    a, b = np.nonzero(rough >= least[:, None] - ROOM)
                    score = (q[a] * matrix[b]).sum(axis=1)  # the same for equal vectors, wherever they stand
                    yield pa.RecordBatch.from_arrays([asked_.field("query_id").take(pa.array(a)), ids.take(pa.array(b)), pa.array(score)], ["query_id", "id", "score"])

        return met.mapInArrow(run, f"query_id {kind}, id {self.id_type}, score double")

    def nearest(self, queries: DataFrame, k: int, probes: int = 2) -> tuple[DataFrame, DataFrame]:
        """(query_id, id, score, rank) as ``retrieval.nearest`` gives it, and one row (pairs, scored) with all pairs and those that were scored.

        queries: query_id, query. Queries without a cosine have no result.
        """
        centres, widths, counts = self.centres, self.widths, self.counts
        size = centres.shape[1] if len(centres) else 0
        kind = queries.schema["query_id"].dataType.simpleString()
        live = np.flatnonzero(counts)

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The cells that each query probes: without a score the nearest ones, else the others whose bound reaches it."""
            for batch in batches:
                rows, good = _matrix(batch.column(1), size)
                unit, out = _unit(rows), []
                reached = batch.column(2).to_numpy(zero_copy_only=False)
                near = np.clip(unit @ centres[live].T, -1, 1) if len(live) else np.zeros((len(rows), 0))
                bound = np.cos(np.maximum(0, np.arccos(near) - widths[live] - 1e-7))
                order = np.argsort(-bound, axis=1, kind="stable")
                for r in np.flatnonzero(good).tolist():
                    first = order[r, :probes]
                    own = first if np.isnan(reached[r]) else order[r, probes:][bound[r, order[r, probes:]] >= reached[r] - ROOM]
                    out += [(r, int(live[c])) for c in own]
                at = pa.array([r for r, _ in out], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([unit[r].tobytes() for r, _ in out], pa.binary()), pa.array([c for _, c in out], pa.int32())], ["query_id", "unit", "cell"])

        probe = lambda df: checkpointed(df.mapInArrow(cells, f"query_id {kind}, unit binary, cell int"))
        best = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))).filter(F.col("rank") <= k)
        first = probe(queries.select("query_id", "query", F.lit(None).cast("double").alias("reached")))
        found = checkpointed(best(self._probe(queries, first, k)).drop("rank"))
        reached = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-2.0).alias("reached"))  # below any bound: not yet k
        second = probe(queries.join(reached, "query_id").select("query_id", "query", "reached"))
        out = best(found.unionByName(self._probe(queries, second, k)))
        sizes = F.element_at(F.array(*(F.lit(int(c)) for c in counts.tolist())), F.col("cell") + 1) if len(counts) else F.lit(0)
        scored = first.unionByName(second).agg(F.coalesce(F.sum(sizes), F.lit(0)).cast("long").alias("scored"))
        report = scored.select(F.lit(queries.count() * int(counts.sum())).cast("long").alias("pairs"), "scored")
        return out.select("query_id", "id", "score", "rank"), report
