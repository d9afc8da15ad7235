"""Containment of nested intervals by a sweep: rows of one sort per group, no row meets another by comparison.

Rows of a group (a page, say) lie at places ``pos``; an interval reaches from behind its own place to ``last``, and intervals
nest or lie apart. In order of place, an interval that opens raises the depth and one that ends lowers it. What encloses
a row at depth d is, for each depth up to d, the last interval that opened at that depth: two windows over one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enclosing(rows: DataFrame, key: str, outer: Column, inner: Column, every: bool = False, pos: str = "pos", last: str = "last") -> DataFrame:
    """The rows that ``inner`` picks, with ``around``: the place of the nearest of the intervals that ``outer`` picks and the row
    lies in, null if there is none. With ``every``, a row for each of them, and none for a row outside all. A row doesn't lie in itself.
    ``key`` and ``pos`` say which row it is; other columns are kept, whatever their names."""
    columns = rows.columns
    own = rows.select(F.col(key).alias("_key"), F.col(pos).alias("_pos"), F.col(last).alias("_last"), F.coalesce(outer, F.lit(False)).alias("_outer"), F.coalesce(inner, F.lit(False)).alias("_inner"), F.struct(*columns).alias("_row"))
    # at one place: what stands there, then what opens, then what ends
    events = own.where("_inner OR _outer").select("_key", "_pos", F.explode(F.array_compact(F.array(
        F.when(F.col("_inner"), F.struct(F.lit(0).alias("phase"), F.col("_pos").alias("at"), F.lit(0).alias("step"), F.col("_row").alias("row"))),
        F.when(F.col("_outer"), F.struct(F.lit(1).alias("phase"), F.col("_pos").alias("at"), F.lit(1).alias("step"), F.lit(None).cast(own.schema["_row"].dataType).alias("row"))),
        F.when(F.col("_outer"), F.struct(F.lit(2).alias("phase"), F.col("_last").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast(own.schema["_row"].dataType).alias("row"))),
    ))).alias("_e")).select("_key", "_pos", "_e.*")
    order = ["at", "phase"]
    events = events.withColumn("depth", F.sum("step").over(Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    events = events.where("phase < 2")
    if every:
        events = events.withColumn("depth", F.explode(F.when(F.col("phase") == 1, F.array("depth")).when(F.col("depth") > 0, F.sequence(F.lit(1), F.col("depth")))))
    opened = F.last(F.when(F.col("phase") == 1, F.col("_pos")), ignorenulls=True)
    found = events.withColumn("around", opened.over(Window.partitionBy("_key", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return found.where("phase = 0").select(*(F.col(f"row.{c}").alias(c) for c in columns), F.when(F.col("depth") > 0, F.col("around")).alias("around"))
