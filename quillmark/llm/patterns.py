"""Row pattern matching: ``A (D|U)* P D*`` over the ordered rows of each key.

A is any row with a value; D is below and U above the row before it, neither of a bad kind; P is of the goal kind and at
least A. D, U and P follow the row before within ``GAP``. The search starts at a key's first row, moves on by a row
without a match and to a match's last row after one.

* Rows are dealt by ranges of (key, time, id), so that a hot key has many tasks, and sorted there.
* A **segment** is a run of rows that a match can lie in: it ends where a row can be neither D, U nor P. A task encodes its
  segments as one bytearray of symbols: ``D`` and ``U``, in lower case where the row is a goal too, ``p`` for a goal that
  equals the row before, and ``A`` for the first row of a segment, which no other symbol's class has.
* The starts that the search can reach are processed by ascending cents. Goals that lie below the start are switched off
  in the bytearray: once off they stay off. An anchored match of the ``regex`` module at the start gives the match's end.
* The search then walks over the matches by position.
* A segment that may go on in the next partition is handed over: the open ends that meet at one seam are matched together.
* Matches are numbered by sums over blocks of partitions whose sizes are powers of two, so no task sees all of a key's partitions.

What one task must hold is one segment and its matches (a match's labels are one string). No row is dropped to bound it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import checkpointed, discard, lean
from quillmark.llm.graph import connected_components

GAP_SECONDS = 15 * 60
GOAL, BAD = "view", ("error",)
#: Rows that one partition is planned for.
ROWS = 250_000

#: Flags of a row.
VALUE, FINE, GOES, NO_ID = 1, 2, 4, 8
ROW = np.dtype([("key", "<i8"), ("ts", "<i8"), ("id", "<i8"), ("cents", "<i8"), ("flag", "u1")])

_MATCH = regex.compile(rb".[DUdu]*([dup])[Dd]*", regex.DOTALL)

_FOUND = "part long, open boolean, through boolean, before long, rows binary, key long, edge boolean, local long, first_id long, last_id long, n_rows long, sum_cents long, labels string"
_ARROW = pa.schema([("part", pa.int64()), ("open", pa.bool_()), ("through", pa.bool_()), ("before", pa.int64()), ("rows", pa.binary()), ("key", pa.int64()), ("edge", pa.bool_()), ("local", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_rows", pa.int64()), ("sum_cents", pa.int64()), ("labels", pa.string())])


def cuts(rows: np.ndarray, gap: int) -> np.ndarray:
    """Which rows begin a segment: they can follow the row before neither as D or U nor as P."""
    cut = np.ones(len(rows), dtype=bool)
    if len(rows) > 1:
        a, b = rows[:-1], rows[1:]
        follows = (a["key"] == b["key"]) & (b["ts"] - a["ts"] <= gap) & ((a["flag"] & VALUE) > 0) & ((b["flag"] & VALUE) > 0)
        goal = (b["flag"] & GOES) > 0
        moves = ((b["flag"] & FINE) > 0) & (a["cents"] != b["cents"])
        cut[1:] = ~(follows & (goal | moves))
    return cut


def _ahead(cells: np.ndarray, block: np.ndarray, rank: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """For each row the highest rank of a goal behind it that its run can reach, else -1. block: of each row as a start."""
    n = len(rank)
    best = np.full(n + 1, -1, dtype=np.int64)
    at = np.flatnonzero(goal)
    best[at] = (block[-1] - block[at - 1]) * n + rank[at]
    best = np.maximum.accumulate(best[::-1])[::-1][1:]
    return np.where((best >= 0) & (best // n == block[-1] - block), best % n, -1)


def matches(rows: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    """(first, goal, last) of each match in rows of whole segments, in order."""
    n = len(rows)
    if n < 2:
        return []
    cut = cuts(rows, gap)
    cents = rows["cents"]
    step = np.sign(np.diff(cents, prepend=cents[:1]))
    down, level = (step < 0) & ~cut, (step == 0) & ~cut
    goal = ((rows["flag"] & GOES) > 0) & ~cut
    if not goal.any():
        return []
    kind = np.where(down, ord("D"), ord("U"))
    symbol = np.where(cut, ord("A"), np.where(level, ord("p"), np.where(goal, kind + 32, kind))).astype(np.uint8)
    stop = cut | (symbol == ord("p"))  # a run of D and U ends before such a row
    block = np.cumsum(stop)
    rank = np.unique(cents, return_inverse=True)[1].astype(np.int64)
    ahead = _ahead(cents, block, rank, goal)
    able = (ahead >= rank) & ((rows["flag"] & VALUE) > 0)
    # a match can only end behind a goal that no later one of its block reaches
    at = np.flatnonzero(goal)
    later = np.where(symbol[at] == ord("p"), -1, ahead[at])
    last = at[rank[at] > later]
    more = np.append(down[1:], False)  # the next row is D
    ends = np.minimum.accumulate(np.where(more, n, np.arange(n))[::-1])[::-1]
    may = cut.copy()
    may[1:] |= ~able[:-1]
    may[ends[last]] = True
    starts = np.flatnonzero(able & may)
    word = bytearray(symbol.tobytes())
    off = {ord("d"): ord("D"), ord("u"): ord("U"), ord("p"): ord("x")}
    goals = at[np.argsort(cents[at], kind="stable")].tolist()
    level_of = cents.tolist()
    end: dict[int, tuple[int, int]] = {}
    k = 0
    for s in starts[np.argsort(cents[starts], kind="stable")].tolist():
        while k < len(goals) and level_of[goals[k]] < level_of[s]:
            word[goals[k]] = off[word[goals[k]]]
            k += 1
        m = _MATCH.match(word, s)
        if m is not None:
            end[s] = m.start(1), m.end() - 1
    found, now = [], -1
    for s in starts.tolist():
        if s >= now and s in end:
            found.append((s, *end[s]))
            now = end[s][1]
    return found


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    rows = np.zeros(batch.num_rows, dtype=ROW)
    for name in ROW.names:
        column = batch.column(name)
        if pa.types.is_timestamp(column.type):
            column = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64())
        rows[name] = column.fill_null(0).to_numpy(zero_copy_only=False)
    return rows


def _results(rows: np.ndarray, gap: int, before: dict[int, int]) -> Iterator[dict]:
    """Matches in rows of whole segments; before: how many each key had in this part so far, kept up to date."""
    found = matches(rows, gap)
    if not found:
        return
    letters = np.where(np.diff(rows["cents"], prepend=rows["cents"][:1]) < 0, b"D", b"U").astype("S1").tobytes()
    total = np.concatenate([[0], np.cumsum(rows["cents"])])
    for s, p, last in found:
        key = int(rows["key"][s])
        before[key] = before.get(key, 0) + 1
        ids = [None if rows["flag"][k] & NO_ID else int(rows["id"][k]) for k in (s, last)]
        labels = "A" + letters[s + 1 : p].decode() + "P" + "D" * (last - p)
        yield {"key": key, "local": before[key], "first_id": ids[0], "last_id": ids[1], "n_rows": last - s + 1, "sum_cents": int(total[last + 1] - total[s]), "labels": labels}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _scan(gap: int):  # noqa: ANN202
    """Of one sorted partition: matches in segments that lie within it, and its two open ends."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        head: np.ndarray | None = None  # the partition's first segment, once it has ended
        kept: list[np.ndarray] = []
        before: dict[int, int] = {}
        first = None
        waiting: list[dict] = []  # matches of the latest key, which may be the partition's last

        def passed(rows: np.ndarray) -> list[dict]:
            nonlocal waiting
            out = waiting + [{"part": part, "open": False, "edge": r["key"] == first} | r for r in _results(rows, gap, before)]
            now = int(rows["key"][-1])
            waiting = [r for r in out if r["key"] == now != first]
            for key in [k for k in before if k != now]:
                del before[key]
            return [r for r in out if r["key"] != now or now == first]

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _rows(batch)
            first = int(rows["key"][0]) if first is None else first
            cut = np.flatnonzero(cuts(np.concatenate([kept[-1][-1:], rows]), gap)[1:]) if kept else np.flatnonzero(cuts(rows, gap)[1:]) + 1
            if not len(cut):
                kept.append(rows)
                continue
            whole = np.concatenate([*kept, rows[: cut[-1]]])
            kept = [rows[cut[-1] :]]
            if head is None:
                until = np.flatnonzero(cuts(whole, gap))
                until = int(until[1]) if len(until) > 1 else len(whole)
                head, whole = whole[:until], whole[until:]
            if len(whole) and (out := passed(whole)):
                yield _batch(out)
        tail = np.concatenate([*kept, np.zeros(0, dtype=ROW)])
        if len(tail):
            key = int(tail["key"][0])
            yield _batch([r | {"edge": r["key"] == key} for r in waiting])
            count = before.get(key, 0) if head is not None else 0
        else:
            count = 0
        ends = [] if head is None else [{"part": part - 1, "open": True, "through": False, "before": 1, "rows": head.tobytes()}]
        ends.append({"part": part, "open": True, "through": head is None, "before": 2 * count, "rows": tail.tobytes()})
        yield _batch(ends)

    return run


def _seams(gap: int):  # noqa: ANN202
    """Matches in the open ends that meet, one row each: (part, ends in order)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ends in zip(batch.column("part").to_pylist(), batch.column("ends"), strict=True):
                ends = ends.as_py()
                rows = np.concatenate([np.zeros(0, dtype=ROW), *(np.frombuffer(e["rows"], dtype=ROW) for e in ends)])
                before = {}
                for e in ends:  # the segment that began in this part counts on from those before it
                    if e["from"] == part and e["before"] % 2 == 0 and len(e["rows"]):
                        before[int(np.frombuffer(e["rows"][: ROW.itemsize], dtype=ROW)["key"][0])] = e["before"] // 2
                yield _batch([{"part": part, "open": False, "edge": True} | r for r in _results(rows, gap, before)])

    return run


def match_rows(events: DataFrame, key: str = "client_id", at: str = "ts", id: str = "click_id", kind: str = "kind", value: str = "value", gap_seconds: int = GAP_SECONDS, goal: str = GOAL, bad: tuple[str, ...] = BAD, rows_each: int = ROWS) -> DataFrame:
    """key, match_no, first_id, last_id, n_rows, sum_cents, labels of each match; distinct rows of events, ordered by (at, id).

    Rows without key or time do not count; rows with a null value, a value that is no finite number, or a null kind are no
    goal and no step (with a value they can still be A). Rows that repeat in all columns count once; rows that share time and
    id are ordered by cents and kind. An empty table has no matches. Other columns only tell rows apart, whatever their names.
    """
    spark = events.sparkSession
    distinct = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).distinct()
    cents = F.floor(100 * F.col(value).cast("double") + 0.5)
    good = F.col(value).isNotNull() & (F.abs(F.col(value).cast("double")) < 9e16)  # NaN is greater than any number
    known = F.col(kind).isNotNull() & ~F.col(kind).isin(*bad)
    flag = F.when(good, VALUE).otherwise(0) + F.when(known, FINE).otherwise(0) + F.when(known & (F.col(kind) == goal), GOES).otherwise(0) + F.when(F.col(id).isNull(), NO_ID).otherwise(0)
    rows = distinct.select(F.col(key).cast("long").alias("key"), F.col(at).alias("ts"), F.col(id).cast("long").alias("id"), F.when(good, cents).otherwise(0).cast("long").alias("cents"), flag.cast("byte").alias("flag"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // rows_each))
    order = ["key", "ts", "id", "cents", "flag"]
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    gap = gap_seconds * 1_000_000
    found = checkpointed(sorted_rows.mapInArrow(_scan(gap), _FOUND))

    # ends that meet at a seam; a part that one segment fills joins its two seams
    ends = found.filter("open")
    through = ends.filter("through").select((F.col("part") - 1).alias("a"), F.col("part").alias("b"))
    seam = F.col("part")
    if through.limit(1).count():
        roots = connected_components(through).select(F.col("node").alias("part"), "label")
        ends = ends.join(roots, "part", "left")
        seam = F.coalesce("label", "part")
    grouped = ends.groupBy(seam.alias("root")).agg(F.sort_array(F.collect_list(F.struct(F.col("part").alias("from"), (F.col("before") % 2).alias("side"), "before", "rows"))).alias("ends"))
    crossing = grouped.select(F.col("root").alias("part"), F.col("ends")).mapInArrow(_seams(gap), _FOUND)
    every = checkpointed(found.filter("not open").unionByName(crossing).select("key", "part", "edge", "local", "first_id", "last_id", "n_rows", "sum_cents", "labels"))
    discard(found)
    out = [F.col("key").alias(key), (F.col("local") + F.coalesce("shift", F.lit(0))).alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "labels"]

    # a key with rows in several parts: matches in earlier parts are summed over blocks of 2^level parts
    levels = max(1, parts.bit_length())
    counts = every.filter("edge").groupBy("key", (F.col("part") + 1).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    blocks = counts.select("key", "part", "n", level).groupBy("key", "level", F.expr("shiftright(part, level)").alias("block")).agg(F.sum("n").alias("n"))
    wanted = counts.select("key", "part", level).filter(F.expr("shiftright(part, level) % 2 = 1")).select("key", "part", "level", F.expr("shiftright(part, level) - 1").alias("block"))
    shifts = wanted.join(blocks, ["key", "level", "block"]).groupBy("key", "part").agg(F.sum("n").alias("shift")).select("key", (F.col("part") - 1).alias("part"), "shift")
    return every.join(shifts, ["key", "part"], "left").select(*out)


#: The same rows in SQL: the last goal that each start reaches, then a walk from match to match.
ORACLE = """
WITH RECURSIVE c AS (
  SELECT client_id, click_id, ts, kind, CAST(floor(100 * value + 0.5) AS BIGINT) AS cents, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) AS i
  FROM (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL)
), l AS (
  SELECT *, lag(cents) OVER w AS above, coalesce(ts - lag(ts) OVER w <= INTERVAL 15 MINUTE, false) AND cents IS NOT NULL AS near FROM c WINDOW w AS (PARTITION BY client_id ORDER BY i)
), f AS (
  SELECT *, coalesce(near AND kind <> 'error' AND cents < above, false) AS d, coalesce(near AND kind <> 'error' AND cents > above, false) AS u, coalesce(near AND kind = 'view', false) AS p FROM l
), n AS (
  SELECT *, coalesce(min(CASE WHEN NOT (d OR u) THEN i END) OVER w, 1000000000) AS stop, coalesce(min(CASE WHEN NOT d THEN i END) OVER w, max(i) OVER (PARTITION BY client_id) + 1) - 1 AS tail
  FROM f WINDOW w AS (PARTITION BY client_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), goal AS (
  SELECT a.client_id, a.i AS s, max(b.i) AS p FROM n a JOIN n b ON b.client_id = a.client_id AND b.i > a.i AND b.i <= a.stop AND b.p AND b.cents >= a.cents GROUP BY ALL
), hit AS (
  SELECT goal.client_id, s, goal.p, n.tail AS e FROM goal JOIN n ON n.client_id = goal.client_id AND n.i = goal.p
), later AS (
  SELECT n.client_id, n.i, min(s) OVER (PARTITION BY n.client_id ORDER BY n.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM n LEFT JOIN hit ON hit.client_id = n.client_id AND hit.s = n.i
), walk AS (
  SELECT hit.client_id, hit.s, hit.p, hit.e, 1 AS match_no FROM later JOIN hit ON hit.client_id = later.client_id AND hit.s = later.s WHERE later.i = 1
  UNION ALL
  SELECT hit.client_id, hit.s, hit.p, hit.e, match_no + 1 FROM walk JOIN later ON later.client_id = walk.client_id AND later.i = walk.e JOIN hit ON hit.client_id = later.client_id AND hit.s = later.s
)
SELECT walk.client_id, CAST(match_no AS BIGINT) AS match_no, min(CASE WHEN n.i = s THEN click_id END) AS first_id, min(CASE WHEN n.i = e THEN click_id END) AS last_id, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS sum_cents,
  sha256(string_agg(CASE WHEN n.i = s THEN 'A' WHEN n.i = walk.p THEN 'P' WHEN n.d THEN 'D' ELSE 'U' END, '' ORDER BY n.i)) AS labels_sha256
FROM walk JOIN n ON n.client_id = walk.client_id AND n.i BETWEEN s AND e GROUP BY walk.client_id, match_no
"""
