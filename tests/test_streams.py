"""Streams against what one sorted batch gives, and the store that they write to."""

import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from cairn.operators import progress
from cairn.sources import progress_records
from cairn.streaming import learners

T0 = datetime.datetime(2024, 1, 1)
KINDS = ("visit", "mark", "practice-hit", "practice-miss", "verify-hit", "verify-miss")
SCHEMA = "learner string, at timestamp, ord long, node string, kind string"


def events(n=400):
    rng = random.Random(8)
    rows = [(f"u{rng.randrange(4)}", T0 + datetime.timedelta(minutes=rng.randrange(20_000)), k, rng.choice(("a", "b", "solution:a")), rng.choice(KINDS)) for k in range(n)]
    return rows


def test_late_and_shuffled_streams_equal_the_batch(spark, tmp_path):
    """Three batches in no order, all within the watermark's delay; a last event of another learner lets the others' timers run out."""
    rows = events()
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    spark.createDataFrame([("end", T0 + datetime.timedelta(days=90), 0, "z", "visit")], SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / "3"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    with learners.with_provider(spark):
        query = learners.changes(stream, "30 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(240)
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date("at"))
    want = progress.node_states(batch, ["learner", "node"], ["at", "ord"], date="day")
    assert {tuple(r) for r in learners.states(out).select("learner", "node", "status", "streak", "last").collect()} == {tuple(r) for r in want.collect()}
    by_learner = out.groupBy("learner").agg(F.count_if("entry").alias("e"), F.collect_set(F.when(F.col("opened"), F.col("node"))).alias("o"), F.max("days").alias("d"))
    for r in by_learner.collect():
        own = [x for x in rows if x[0] == r.learner]
        assert r.e == sum("-" in x[4] for x in own) and set(r.o) == {x[3] for x in own if x[4] == "visit" and x[3] != "solution:a"} and r.d == len({x[1].date() for x in own})


class Held:
    """The state of one key, in memory; ``largest``: bytes or rows of the largest value that was put."""

    def __init__(self):
        self.largest, self.timers, self.all = 0, [], []

    def _var(self, name, *schemas):
        held, outer = {}, self

        class Var:
            exists = staticmethod(lambda: bool(held))
            get = staticmethod(lambda: held[()])
            update = staticmethod(lambda v: held.update({(): v}))
            clear = staticmethod(held.clear)
            getValue = staticmethod(held.get)
            containsKey = staticmethod(held.__contains__)
            removeKey = staticmethod(held.pop)
            iterator = staticmethod(lambda: iter(list(held.items())))

            @staticmethod
            def put(rows):
                outer.largest = max(outer.largest, len(rows))
                held[()] = rows

            @staticmethod
            def updateValue(k, v):
                outer.largest = max(outer.largest, *(len(x) for x in v if isinstance(x, bytes)), 0)
                held[k] = v

        self.all.append((name, held))
        return Var

    getMapState = getListState = getValueState = _var

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_events_are_never_held_at_once(monkeypatch):
    """However many events wait, a value of the state and a step have a bounded number of them; the rows are those of one
    sorted fold, over several levels of merged runs and a watermark that passes parts of runs."""
    for name, value in {"RUN": 50, "PART": 7, "STEP": 30, "RUNS": 4}.items():
        monkeypatch.setattr(learners, name, value, raising=False)
    rng = random.Random(5)
    rows = [(rng.randrange(900) * 1_000_000, k if k % 9 else None, k % 5, rng.choice(("a", "b", "solution:a")), rng.choice(KINDS)) for k in range(3_000)]
    frames = [pd.DataFrame(rows[k : k + 110], columns=["us", "ord", "day", "node", "kind"]) for k in range(0, 3_000, 110)]
    held, got = Held(), []
    processor = learners.Progress()
    processor.init(held)
    got += processor.handleInputRows(("u",), iter(frames[:10]), Watermark(0))
    got += processor.handleInputRows(("u",), iter(frames[10:]), Watermark(0))
    assert not got and held.timers == [min(r[0] for r in rows) // 1000 + 1]
    for second in (100, 333, 1_000):
        got += processor.handleExpiredTimer(("u",), Watermark(second * 1_000), None)
    assert max(map(len, got)) <= 30 and held.largest <= 2_000
    assert not held.timers and not [name for name, own in held.all if own and name in ("parts", "runs", "waiting")]
    out = pd.concat(got)
    want = sorted(rows, key=lambda r: (r[0], r[1] is None, r))
    assert list(zip(out["us"], out["node"], out["kind"], strict=True)) == [(r[0], r[3], r[4]) for r in want]
    one = learners.Progress()
    one.init(Held())
    steps = one._steps("u", want)
    assert list(zip(out["status"], out["streak"], out["opened"], out["days"], strict=True)) == [(r[5], r[6], r[9], r[10]) for r in steps]


def test_store_stays_small(spark, tmp_path):
    """Over many batches, some of them run twice, there are few folders, and each key has its last state."""
    path, want = str(tmp_path / "states"), {}
    assert progress_records.kept(spark, path, "node", initial=spark.createDataFrame([("a", 7)], "node string, n long")).collect() == [("a", 7)]
    for k in range(23):
        rows = [(f"n{(k * 3 + j) % 11}", k * 10 + j) for j in range(3)]
        for _ in range(2 if k % 5 == 0 else 1):
            progress_records.store(spark.createDataFrame(rows, "node string, n long").coalesce(1), k, path, "node", most=4)
        want.update(rows)
        assert len([p for p in (tmp_path / "states").iterdir() if p.is_dir()]) <= 6
    assert dict(map(tuple, progress_records.kept(spark, path, "node").collect())) == want


def test_store_after_a_broken_compaction(spark, tmp_path):
    path = str(tmp_path / "states")
    for k in range(3):
        progress_records.store(spark.createDataFrame([("a", k)], "node string, n long"), k, path, "node", most=9)
    (tmp_path / "states" / "snapshot=2").mkdir()  # begun, not ended
    assert progress_records.kept(spark, path, "node").collect() == [("a", 2)]
    progress_records.store(spark.createDataFrame([("b", 3)], "node string, n long"), 3, path, "node", most=2)
    assert sorted(map(tuple, progress_records.kept(spark, path, "node").collect())) == [("a", 2), ("b", 3)]
