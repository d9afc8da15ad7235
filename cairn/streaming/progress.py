"""The node state machine over a stream: state per key is (rank, streak); each batch's events are folded in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.progress import RANK, STATUS


def step(rank: int, streak: int, kind: str) -> tuple[int, int]:
    """One event: a verify-miss demotes what exists and ends the streak; others raise the rank; verify-hits count."""
    if kind == "verify-miss":
        return (min(rank, 1), 0)
    return (max(rank, RANK.get(kind, 0)), streak + (kind == "verify-hit"))


def node_states(events: DataFrame, key: str = "node", key_type: str = "string") -> DataFrame:
    """A streaming DataFrame of key, status, streak: an update per key and batch. events: key, ord (long), kind. Events
    of a batch are sorted by ord; an event that comes in a later batch than its successors counts when it comes."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rank, streak = state.get if state.exists else (0, 0)
        for row in pd.concat(list(batches)).sort_values("ord").itertuples():
            rank, streak = step(rank, streak, row.kind)
        state.update((int(rank), int(streak)))
        yield pd.DataFrame({key: [k[0]], "status": [STATUS[rank]], "streak": [int(streak)]})

    return events.groupBy(key).applyInPandasWithState(fold, f"{key} {key_type}, status string, streak long", "rank int, streak long", "update", GroupStateTimeout.NoTimeout)
