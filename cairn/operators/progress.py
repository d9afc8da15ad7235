"""Learner progress: review states from streaks, the node state machine in closed form, staleness, and the report.

Events of a node in order (ord): visit, mark, practice-hit, practice-miss, verify-hit, verify-miss. Statuses rank visited,
marked, verified. A verify-miss sends an existing node back to visited, creates none and deletes its review; the others
raise it. Keys of solutions have a prefix of their own, since products and solutions may share ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import is_success
from cairn.operators.dimensions import SOLUTION_PREFIX, solution_key

# fixed values: days until the next review by streak
INTERVALS = (1, 4, 14)
RANK = {"visit": 1, "mark": 2, "practice-hit": 2, "verify-hit": 3}
STATUS = ("absent", "visited", "marked", "verified")


def interval_days(streak: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, INTERVALS)), F.least(F.greatest(streak, F.lit(1)), F.lit(len(INTERVALS))).cast("int"))


def due(states: DataFrame, today: str) -> DataFrame:
    """states (last, streak) with the day of the next review and whether it has come."""
    day = F.date_add("last", interval_days(F.col("streak")))
    return states.withColumn("due", day).withColumn("stale", F.col("due") <= F.lit(today).cast("date"))


def review_states(log: DataFrame, keys: list[str], ord: list[str], date: str, success: str, today: str) -> DataFrame:
    """keys, last, streak (successes at the end of the log), due and stale. log has a boolean ``success`` column. The last
    failure of each key is aggregated and joined back, so no key's log is sorted in one task."""
    at = F.struct(*ord)
    fails = log.where(~F.coalesce(F.col(success), F.lit(False))).groupBy(*keys).agg(F.max(at).alias("_failed"))
    rows = log.join(fails, keys, "left")
    out = rows.groupBy(*keys).agg(F.max_by(date, at).alias("last"), F.count_if(F.col("_failed").isNull() | (at > F.col("_failed"))).alias("streak"))
    return due(out, today)


def area_reviews(log: DataFrame, ord: list[str], today: str) -> DataFrame:
    """The review state of each area by its verify sessions alone: log has area, date, kind, correct, total and ``ord``."""
    rows = log.where("kind = 'verify'").withColumn("_ok", is_success(F.col("correct"), F.col("total")))
    return review_states(rows, ["area"], ord, "date", "_ok", today)


def recall_events(placements: DataFrame) -> DataFrame:
    """placements (node, ord, correct, kind practice or verify) as events of the node state machine."""
    outcome = F.concat_ws("-", "kind", F.when(F.col("correct"), "hit").otherwise("miss"))
    return placements.withColumn("kind", outcome)


def solution_events(sessions: DataFrame) -> DataFrame:
    """sessions (solution, ord, effect) as events of the solution's own key: verify raises it, demote sends it back, none
    leaves it as it is."""
    kind = F.when(F.col("effect") == "verify", "verify-hit").when(F.col("effect") == "demote", "verify-miss")
    return sessions.where(kind.isNotNull()).withColumn("kind", kind).withColumn("node", solution_key(F.col("solution").cast("string")))


def recall_log(sessions: DataFrame) -> DataFrame:
    """date, area, kind, correct, total of sessions, in which a solution's area is its key."""
    area = F.when(F.col("solution").isNull(), F.col("area")).otherwise(solution_key(F.col("solution").cast("string")))
    return sessions.select("ord", "date", area.alias("area"), "kind", "correct", "total")


def node_states(events: DataFrame, keys: list[str], ord: list[str], kind: str = "kind", date: str | None = None) -> DataFrame:
    """keys, status, streak, and with ``date`` the day ``last`` of the review (null where there is none): the fold of each
    node's events as an aggregation around its last verify-miss."""
    at = F.struct(*ord)
    rows = events.withColumn("_at", at).withColumn("_rank", F.coalesce(*(F.when(F.col(kind) == k, r) for k, r in RANK.items()), F.lit(0)))
    miss = rows.where(F.col(kind) == "verify-miss").groupBy(*keys).agg(F.max("_at").alias("_miss"))
    rows = rows.join(miss, keys, "left")
    after = F.col("_miss").isNull() | (F.col("_at") > F.col("_miss"))
    hit = after & (F.col(kind) == "verify-hit")
    last = [F.max_by(F.when(hit, F.col(date)), F.when(hit, F.col("_at"))).alias("last")] if date else []
    out = rows.groupBy(*keys).agg(
        F.max(F.when(after, F.col("_rank")).otherwise(F.when(F.col("_rank") > 0, 1).otherwise(0))).alias("_r"),
        F.count_if(hit).alias("streak"), *last,
    )
    return out.select(*keys, F.element_at(F.array(*map(F.lit, STATUS)), (F.col("_r") + 1).cast("int")).alias("status"), "streak", *(["last"] if date else []))


def opened(events: DataFrame, keys: list[str], ord: list[str]) -> DataFrame:
    """keys of the products whose card was opened, with the place of the first visit; solutions are not among them."""
    rows = events.where((F.col("kind") == "visit") & ~F.startswith(keys[-1], F.lit(SOLUTION_PREFIX)))
    return rows.groupBy(*keys).agg(F.min(F.struct(*ord)).alias("_at")).select(*keys, *(F.col(f"_at.{c}").alias(c) for c in ord))


def status_counts(states: DataFrame) -> DataFrame:
    return states.where("status <> 'absent'").groupBy("status").agg(F.count("*").alias("n"))


def progress_counts(states: DataFrame, node: str = "node") -> DataFrame:
    """One row: products seen, products verified, solutions verified."""
    solution, known = F.startswith(node, F.lit(SOLUTION_PREFIX)), F.col("status") != "absent"
    verified = F.col("status") == "verified"
    return states.agg(F.count_if(known & ~solution).alias("revealed"), F.count_if(verified & ~solution).alias("verified"), F.count_if(verified & solution).alias("solutions_verified"))


def session_days(events: DataFrame, user: str, day: Column) -> DataFrame:
    return events.select(F.col(user), day.alias("day")).distinct().groupBy(user).agg(F.count("*").alias("n_days"))


# staleness ------------------------------------------------------------------------------------------------------------
def stale_nodes(states: DataFrame, reviews: DataFrame, placements: DataFrame, areas: DataFrame) -> DataFrame:
    """states (node, status) with ``stale``: by the node's own review, else whether any area it lies in is stale, and
    ``refogged``: verified and stale. reviews: node, stale; placements: node, area; areas: area, stale."""
    laid = placements.join(areas.select("area", "stale"), "area").groupBy("node").agg(F.bool_or("stale").alias("_area"))
    rows = states.join(reviews.select("node", F.col("stale").alias("_own")), "node", "left").join(laid, "node", "left")
    rows = rows.withColumn("stale", F.coalesce("_own", "_area", F.lit(False))).drop("_own", "_area")
    return rows.withColumn("refogged", (F.col("status") == "verified") & F.col("stale"))


def stale_areas(nodes: DataFrame, placements: DataFrame) -> DataFrame:
    """The areas that hold a verified node whose review has come. nodes: node, refogged."""
    return placements.join(nodes.where("refogged").select("node"), "node", "left_semi").select("area").distinct()


def stale_solutions(solutions: DataFrame, states: DataFrame, reviews: DataFrame) -> DataFrame:
    """The solutions (id) that are verified and whose review has come."""
    keyed = solutions.withColumn("node", solution_key(F.col("id").cast("string")))
    return keyed.join(states.where("status = 'verified'").select("node"), "node", "left_semi").join(reviews.where("stale").select("node"), "node", "left_semi").drop("node")


def area_flags(areas: DataFrame, stale: DataFrame) -> DataFrame:
    """area and whether it is stale, of all areas."""
    return areas.select("area").distinct().join(stale.select("area").distinct().withColumn("_s", F.lit(True)), "area", "left").select("area", F.col("_s").isNotNull().alias("stale"))


def lens_flags(lenses: DataFrame, reviews: DataFrame) -> DataFrame:
    """id of each lens (a solution) and whether the review of its own node has come, verified or not. reviews: node, stale."""
    keyed = lenses.select("id", solution_key(F.col("id").cast("string")).alias("node"))
    return keyed.join(reviews.select("node", "stale"), "node", "left").select("id", F.coalesce("stale", F.lit(False)).alias("stale"))


def stale_total(areas: DataFrame, solutions: DataFrame) -> DataFrame:
    """One row: how many areas and solutions are due."""
    return areas.select(F.lit(1).alias("x")).unionByName(solutions.select(F.lit(1).alias("x"))).agg(F.count("*").alias("stale_total"))


def report(slots: DataFrame, notes: DataFrame, opened_ids: DataFrame, areas: DataFrame, counts: DataFrame, solutions: DataFrame, stale: DataFrame, exported_at: str | None = None) -> DataFrame:
    """One row, as exported: recall_rate, slot_total, note_read_rate, stale_areas, solution_verified, solution_total,
    stale_solutions, exported_at. Rates of nothing are null. slots: slots, verified; notes and opened_ids: id; solutions: the composed
    ones (``composed``), which alone can be recalled."""
    read = notes.select("id").join(opened_ids.select("id").distinct().withColumn("_o", F.lit(1)), "id", "left").agg(F.count("_o").alias("read"), F.count("*").alias("notes"))
    listed = lambda rows, key, name: rows.agg(F.array_sort(F.collect_set(F.col(key).cast("string"))).alias(name))
    parts = [read, counts.select("solutions_verified"), solutions.agg(F.count("*").alias("solution_total")), listed(areas, "area", "stale_areas"), listed(stale, "id", "stale_solutions")]
    row = slots
    for part in parts:
        row = row.crossJoin(F.broadcast(part))  # one row each
    return row.select(
        F.try_divide("verified", "slots").alias("recall_rate"), F.col("slots").alias("slot_total"), F.try_divide("read", "notes").alias("note_read_rate"), "stale_areas",
        F.col("solutions_verified").alias("solution_verified"), "solution_total", "stale_solutions", F.lit(exported_at).cast("string").alias("exported_at"),
    )
