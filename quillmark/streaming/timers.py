"""State machines with deadlines: keyed state, event-time timers, and rows put in order by the watermark.

Rows wait in the state of their key until the watermark has passed them; then they and the deadlines that fell due are
taken in the order of time. So neither the cut into batches nor the order in which rows arrive within the watermark changes the outcome.
A key has one timer: for the earliest of its waiting rows and its deadline. A key that is back in its first state, with nothing
waiting, has no state at all, so state follows the keys that are busy.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Machine:
    """From a state, by an event, to a state; anything else is ignored. deadlines: for a state, after how many seconds which event comes by itself."""

    first: str
    steps: dict[tuple[str, str], str]
    deadlines: dict[str, tuple[int, str]] = field(default_factory=dict)


#: A gap in a day's data is read again after an hour, unless it has been filled; a gap while one is pending is covered by it.
RETRY = Machine("idle", {("idle", "gap"): "pending", ("pending", "filled"): "idle", ("pending", "retry"): "idle"}, {"pending": (3600, "retry")})

#: A correction that waits for its confirmation expires after a week.
APPROVAL = Machine(
    "draft",
    {("draft", "propose"): "agent_proposed", ("agent_proposed", "ask"): "awaiting_confirm", ("awaiting_confirm", "confirm"): "applied", ("awaiting_confirm", "reject"): "rejected", ("awaiting_confirm", "expire"): "expired", ("applied", "deactivate"): "deactivated"},
    {"awaiting_confirm": (7 * 86400, "expire")},
)


def walk(machine: Machine, status: str, due: int | None, rows: list[tuple[int, int, str]], until: int) -> tuple[str, int | None, list[tuple[int, str, str]]]:
    """The state and deadline after rows (at, seq, event) and deadlines up to a time, and the transitions (at, event, status); times are microseconds.

    A deadline comes before a row of the same time.
    """
    out = []

    def take(at: int, event: str) -> None:
        nonlocal status, due
        following = machine.steps.get((status, event))
        if following is not None:
            status = following
            wait = machine.deadlines.get(status)
            due = None if wait is None else at + 1_000_000 * wait[0]
            out.append((at, event, status))

    def expire(upto: int) -> None:
        while due is not None and due <= upto:
            take(due, machine.deadlines[status][1])

    for at, _, event in sorted(rows):
        expire(at)
        take(at, event)
    expire(until)
    return status, due, out


class Deadlines(StatefulProcessor):
    def __init__(self, machine: Machine) -> None:
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, due long")
        self.waiting = handle.getListState("waiting", "at long, seq long, event string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(at), int(seq), event) for part in rows for at, seq, event in zip(part["at"], part["seq"], part["event"], strict=True)]
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = 1000 * timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in waiting if r[0] <= until], [r for r in waiting if r[0] > until]
        status, due = self.now.get() if self.now.exists() else (self.machine.first, None)
        status, due, out = walk(self.machine, status, due, ready, until)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if status == self.machine.first:
            self.now.clear()
        else:
            self.now.update((status, due))
        times = [r[0] for r in later] + ([due] if due is not None else [])
        if times:
            self._wake(min(times), expiredTimerInfo.getExpiryTimeInMs())
        if not out:
            return iter(())
        plain = lambda k: pd.Series([o[k] for o in out], dtype=object)
        return iter([pd.DataFrame({"id": pd.Series([key[0]] * len(out), dtype=object), "at": pd.Series([o[0] for o in out], dtype="int64"), "event": plain(1), "status": plain(2)})])

    def _wake(self, at: int, fired: int | None = None) -> None:
        """One timer, at the earliest time that is asked for; the one that has just fired is still listed."""
        own = -(-at // 1000)
        known = [t for t in self.handle.listTimers() if t != fired]
        if not known or min(known) > own:
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(own)

    def close(self) -> None:
        pass


def transitions(events: DataFrame, machine: Machine, late: str = "10 minutes") -> DataFrame:
    """(id, at, event, status) for each transition, from a stream of events (id string, at timestamp, seq long, event string).

    Rows later than the watermark are dropped by Spark; null ids, times and events are left out. The state is RocksDB's: see ``rocksdb``.
    """
    kept = events.filter("id IS NOT NULL AND at IS NOT NULL AND event IS NOT NULL").withWatermark("at", late)
    rows = kept.select("id", F.col("at").alias("_time"), F.unix_micros("at").alias("at"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "event")
    found = rows.groupBy("id").transformWithStateInPandas(Deadlines(machine), "id string, at long, event string, status string", "append", "EventTime")
    return found.select("id", F.timestamp_micros("at").alias("at"), "event", "status")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
