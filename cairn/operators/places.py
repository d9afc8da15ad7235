"""Places of rows in an order over the whole table, without a task that sees all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.shared import written


def placed(rows: DataFrame, order: list, name: str = "ord") -> DataFrame:
    """rows with their place from 0. Rows are dealt by ranges of the order; a place is the number of rows in the ranges
    before, from counts, plus the row's number in its own. Rows that tie in the whole order get places in any order."""
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_range", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_number", number).join(F.broadcast(counts), "_range").withColumn(name, F.col("_before") + F.col("_number")).drop("_range", "_number", "_before")


def _ranges(rows: DataFrame, keys: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """rows dealt by ranges of keys and order, many to a large key, written; and keys, _range, _before: the rows of the key in the
    ranges before, from counts, of which a key has as many as it spans ranges."""
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged, counts.select(*keys, "_range", before.alias("_before"))


def _numbered(ranged: DataFrame, before: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    own = before.toDF(*(f"_b{k}" for k in range(len(keys))), "_brange", *before.columns[len(keys) + 1 :])
    same = (F.col("_range") == F.col("_brange")) & reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate(keys)))
    met = ranged.join(own, same).withColumn(name, F.col("_before") + number)
    return (met.where(F.col(name) <= F.col("_limit")) if "_limit" in own.columns else met).drop("_range", "_before", *own.columns)


def placed_within(rows: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    """rows with their place within their key, from 1. However large a key, no task sorts more of it than a range; a null key is
    a key. Rows that tie in the whole order get places in any order."""
    return _numbered(*_ranges(rows, keys, order), keys, order, name)


def first_within(rows: DataFrame, keys: list[str], order: list, most: int | DataFrame, name: str = "place") -> DataFrame:
    """The first rows of each key, with their place: ``most`` of them, or as many as a table of keys and ``most`` says (none where it
    has no row). Ranges that begin behind the last place are not numbered."""
    ranged, before = _ranges(rows, keys, order)
    if isinstance(most, DataFrame):
        own = most.toDF(*(f"_m{k}" if c in keys else "_most" for k, c in enumerate(most.columns)))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_m{k}")) for k, c in enumerate(most.columns) if c in keys))
        before = before.join(own, same).select(*before.columns, "_most")
    else:
        before = before.withColumn("_most", F.lit(most))
    return _numbered(ranged, before.where("_before < _most").select(*keys, "_range", "_before", F.col("_most").alias("_limit")), keys, order, name)
