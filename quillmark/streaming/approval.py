"""Feedback that waits for a person: a state machine keyed by feedback."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: From a state, by an event, to a state; anything else is ignored.
STEPS = {
    ("draft", "propose"): "agent_proposed",
    ("agent_proposed", "ask"): "awaiting_confirm",
    ("awaiting_confirm", "confirm"): "applied",
    ("awaiting_confirm", "reject"): "rejected",
    ("applied", "deactivate"): "deactivated",
}


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, seen = state.get if state.exists else ("draft", -1)
    out = []
    for rows in batches:
        for row in rows.sort_values("seq").itertuples():
            if row.seq > seen:  # a replayed event has been counted
                seen = int(row.seq)
                following = STEPS.get((status, row.event))
                if following:
                    status = following
                    out.append((key[0], seen, status))
    state.update((status, seen))
    yield pd.DataFrame(out, columns=["id", "seq", "status"])


def states(events: DataFrame) -> DataFrame:
    """(id, seq, status) for each transition, from events (id, seq, event)."""
    return events.groupBy("id").applyInPandasWithState(advance, "id string, seq long, status string", "status string, seen long", "append", GroupStateTimeout.NoTimeout)
