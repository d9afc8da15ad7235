"""The state of each learner over a stream of events, in the order of their time.

Events wait in the learner's state until the watermark has passed them and are then folded in order, so late and shuffled
batches give what one sorted batch gives. They wait as sorted runs in parts of a bounded number of events; runs are merged part by
part, so Python holds a part of each run and never a learner's events. A timer wakes a learner whose events wait when no more of
its own come. Nodes, opened cards and days are maps in the state: a step reads and writes those that its events touch, once each,
not the learner.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from cairn.operators.dimensions import SOLUTION_PREFIX
from cairn.operators.progress import RANK, STATUS

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: A row per folded event; us: its time in microseconds, last: the day of the node's review, days since 1970.
OUT = "learner string, us long, ord long, node string, kind string, status string, streak long, last int, entry boolean, opened boolean, days long"
RECALLS = frozenset(("practice-hit", "practice-miss", "verify-hit", "verify-miss"))


#: Events that are sorted at once, of a part, and of a step; runs of a level that are merged into one of the next.
RUN, PART, STEP, RUNS = 20_000, 500, 5_000, 64
#: An event that waits.
EVENT = pa.schema([("us", pa.int64()), ("ord", pa.int64()), ("day", pa.int32()), ("node", pa.string()), ("kind", pa.string())])


def _order(event: tuple) -> tuple:
    return (event[0], event[1] is None, event)


def _listed(column: pd.Series) -> list:
    """Pandas has whole numbers with nulls among them as floats."""
    return [None if x != x else int(x) for x in column] if column.dtype.kind == "f" else column.tolist()


def _packed(events: list[tuple]) -> tuple[bytes]:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*events, strict=True), EVENT, strict=True)]
    return (pa.record_batch(columns, schema=EVENT).serialize().to_pybytes(),)


def _unpacked(part: tuple) -> list[tuple]:
    batch = pa.ipc.read_record_batch(pa.py_buffer(bytes(part[0])), EVENT)
    return list(zip(*(c.to_pylist() for c in batch.columns), strict=True))


class Progress(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "run long, part long", "events binary")
        self.runs = handle.getMapState("runs", "run long", "level int, first long, last long, us long")
        self.nodes = handle.getMapState("nodes", "node string", "rank int, streak long, last int")
        self.opened = handle.getMapState("opened", "node string", "us long")
        self.days = handle.getMapState("days", "day int", "us long")
        self.count = handle.getValueState("count", "days long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        yield from self._fold(key, (x for b in rows for x in zip(*(_listed(b[c]) for c in EVENT.names), strict=True)), timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fold(key, iter(()), timerValues)

    def _fold(self, key: tuple, came: Iterator[tuple], timers: TimerValues) -> Iterator[pd.DataFrame]:
        """Folds what the watermark has passed; what still waits sets a timer at its first event."""
        passed = timers.getCurrentWatermarkInMs() * 1000
        held = {k[0]: tuple(v) for k, v in self.runs.iterator()} if self.runs.exists() else {}
        runs = dict(held)
        while run := sorted(islice(came, RUN), key=_order):
            self._keep(runs, iter(run), 0)
        ready = self._merged(runs, [r for r, v in runs.items() if v[3] < passed], passed)
        while events := list(islice(ready, STEP)):
            yield pd.DataFrame(self._steps(key[0], events), columns=[c.split()[0] for c in OUT.split(", ")]).astype({"last": "Int32"})
        for run in held.keys() - runs.keys():
            self.runs.removeKey((run,))
        for run, value in runs.items():
            if held.get(run) != value:
                self.runs.updateValue((run,), value)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if runs:
            self.handle.registerTimer(min(v[3] for v in runs.values()) // 1000 + 1)

    def _keep(self, runs: dict[int, tuple], events: Iterator[tuple], level: int) -> None:
        """Keeps sorted events as a run (level, its first part and the one behind its last, time of its first event); many runs
        of a level become one of the next."""
        run, last, us = max(runs, default=-1) + 1, 0, None
        while part := list(islice(events, PART)):
            us = part[0][0] if us is None else us
            self.parts.updateValue((run, last), _packed(part))
            last += 1
        runs[run] = (level, 0, last, us)
        alike = [r for r, v in runs.items() if v[0] == level]
        if len(alike) >= RUNS:
            self._keep(runs, self._merged(runs, alike), level + 1)

    def _merged(self, runs: dict[int, tuple], some: list[int], before: int | None = None) -> Iterator[tuple]:
        return heapq.merge(*(self._taken(runs, r, before) for r in some), key=_order)

    def _taken(self, runs: dict[int, tuple], run: int, before: int | None) -> Iterator[tuple]:
        """The events of a run (before a time), which leave the state."""
        level, first, last, _ = runs[run]
        for k in range(first, last):
            part = _unpacked(self.parts.getValue((run, k)))
            n = len(part) if before is None else bisect_left(part, before, key=lambda e: e[0])
            yield from part[:n]
            if n < len(part):
                if n:
                    self.parts.updateValue((run, k), _packed(part[n:]))
                runs[run] = (level, k, last, part[n][0])
                return
            self.parts.removeKey((run, k))
        del runs[run]

    def _steps(self, learner: str, events: list[tuple]) -> list[tuple]:
        nodes = {n: self.nodes.getValue((n,)) if self.nodes.containsKey((n,)) else (0, 0, None) for n in {e[3] for e in events}}
        seen = {n for n in nodes if self.opened.containsKey((n,))}
        known = {d for d in {e[2] for e in events} if self.days.containsKey((d,))}
        days, out = self.count.get()[0] if self.count.exists() else 0, []
        for us, ord_, day, node, kind in events:
            rank, streak, last = nodes[node]
            if kind == "verify-miss":
                rank, streak, last = min(rank, 1), 0, None
            elif kind == "verify-hit":
                rank, streak, last = RANK[kind], streak + 1, day
            else:
                rank = max(rank, RANK.get(kind, 0))
            nodes[node] = (rank, streak, last)
            first = kind == "visit" and not node.startswith(SOLUTION_PREFIX) and node not in seen
            if first:
                seen.add(node)
                self.opened.updateValue((node,), (us,))
            if day not in known:
                known.add(day)
                self.days.updateValue((day,), (us,))
                days += 1
            out.append((learner, us, ord_, node, kind, STATUS[rank], streak, last, kind in RECALLS, first, days))
        for node, state in nodes.items():
            self.nodes.updateValue((node,), state)
        self.count.update((days,))
        return out

    def close(self) -> None:
        pass


def changes(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A row per event, once the watermark (``late`` behind the latest event) has passed it: the state of its node after it (status,
    streak, the day of its review), whether it is an entry of the recall log, whether it opened a card, and on how many days the
    learner has been there. events: learner, at (timestamp), ord (which orders events of one instant), node, kind. What comes
    later than the watermark is dropped, and so is what has no time. The session must have the state store of ``PROVIDER``."""
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = events.select(text("learner"), F.col("at").cast("timestamp").alias("at"), F.col("ord").cast("long").alias("ord"), text("node"), text("kind"))
    rows = rows.withColumns({"us": F.unix_micros("at"), "day": F.datediff(F.to_date("at"), F.lit("1970-01-01").cast("date"))}).where("at IS NOT NULL").withWatermark("at", late)
    found = rows.groupBy("learner").transformWithStateInPandas(Progress(), OUT, "Append", "EventTime")
    return found.withColumns({"at": F.timestamp_micros("us"), "last": F.date_add(F.lit("1970-01-01").cast("date"), F.col("last"))}).drop("us")


def states(changed: DataFrame) -> DataFrame:
    """learner, node, status, streak, last: after the last change of each node, of a table of changes."""
    return changed.groupBy("learner", "node").agg(F.max_by(F.struct("status", "streak", "last"), F.struct("at", "ord")).alias("_s")).select("learner", "node", "_s.*")


def with_provider(spark: SparkSession):
    """A context in which streams that are started have the state store that ``changes`` needs."""
    from contextlib import contextmanager

    @contextmanager
    def held():
        before = spark.conf.get(PROVIDER[0], None)
        spark.conf.set(*PROVIDER)
        try:
            yield
        finally:
            spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])

    return held()
