"""Registered queries that run a stream over the events to its end, each with its SQL.

Roles: learner = a twentieth of the users, node = a seventh of the events, what an event means by its type; the stream reads the table's
files and stops when it has read all. What lies within an hour of the latest event still waits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.registry import query, t
from cairn.sources.shared import shared_dir
from cairn.streaming import learners

# fixed values: what the table's types of events stand for here
KINDS = {"view": "visit", "click": "mark", "purchase": "verify-hit", "error": "verify-miss"}


def _changes(s, d) -> DataFrame:
    e = s.readStream.schema(t(s, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, since the table may be a file
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("event_type")), F.lit("practice-hit"))
    rows = e.select((F.col("user_id") % 20).alias("learner"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("node"), kind.alias("kind"))
    path = f"{shared_dir(s).rstrip('/')}/cairn-{s.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    with learners.with_provider(s):
        made = learners.changes(rows)
        made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(made.schema).parquet(f"{path}/out")


_EVENTS = """WITH e AS (SELECT (user_id % 20)::VARCHAR AS learner, 'p' || event_id % 7 AS node, event_id AS ord, ts, CASE event_type WHEN 'view' THEN 'visit' WHEN 'click' THEN 'mark' WHEN 'purchase' THEN 'verify-hit' WHEN 'error' THEN 'verify-miss' ELSE 'practice-hit' END AS kind FROM events
        WHERE epoch_us(ts) < ((SELECT epoch_ms(max(ts)) FROM events) - 3600000) * 1000),
    m AS (SELECT *, max(CASE WHEN kind = 'verify-miss' THEN (ts, ord) END) OVER (PARTITION BY learner, node) AS miss FROM e),
    a AS (SELECT *, miss IS NULL OR (ts, ord) > miss AS after, CASE kind WHEN 'visit' THEN 1 WHEN 'mark' THEN 2 WHEN 'practice-hit' THEN 2 WHEN 'verify-hit' THEN 3 ELSE 0 END AS r FROM m)"""


@query(_EVENTS + """, g AS (SELECT learner, node, max(CASE WHEN after THEN r WHEN r > 0 THEN 1 ELSE 0 END) AS r, count(*) FILTER (after AND r = 3) AS streak, max(ts) FILTER (after AND r = 3) AS last FROM a GROUP BY 1, 2)
    SELECT learner, node, ['absent', 'visited', 'marked', 'verified'][r + 1] AS status, streak, strftime(last, '%Y-%m-%d') AS last FROM g""")
def streamed_states(s, d):
    return learners.states(_changes(s, d)).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


@query(_EVENTS + """ SELECT learner, count(*) AS changes, count(*) FILTER (kind IN ('practice-hit', 'verify-hit', 'verify-miss')) AS entries, count(DISTINCT CASE WHEN kind = 'visit' THEN node END) AS opened, count(DISTINCT ts::DATE) AS days FROM e GROUP BY 1""")
def streamed_logs(s, d):
    return _changes(s, d).groupBy("learner").agg(F.count("*").alias("changes"), F.count_if("entry").alias("entries"), F.count_if("opened").alias("opened"), F.max("days").alias("days"))
