"""Merging partial claims about entities: precedence, conflicts, unions of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(claims: DataFrame, key: str, field: str, precedence: str) -> DataFrame:
    """key, ``field`` at its highest precedence (the smallest of several), and how many distinct values that level has.
    The maximum per key is aggregated before it meets the claims."""
    stated = claims.where(F.col(field).isNotNull())
    level = stated.groupBy(key, precedence).agg(F.min(field).alias(field), F.count_distinct(field).alias("n_values"))
    return level.groupBy(key).agg(F.max(F.struct(precedence, field, "n_values")).alias("_top")).select(key, f"_top.{field}", "_top.n_values")


def conflicts(claims: DataFrame, key: str, field: str, precedence: str) -> DataFrame:
    return pick(claims, key, field, precedence).where("n_values > 1")


def source_union(claims: DataFrame, keys: list[str], source: str, sep: str = ",") -> DataFrame:
    """keys and their distinct sources, sorted and joined."""
    return claims.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.col(source).cast("string"))), sep).alias("sources"))


def best_url(claims: DataFrame, key: str, url: str, precedence: str) -> DataFrame:
    """The URL of the highest precedence; of several, the smallest."""
    return claims.groupBy(key).agg(F.min_by(url, F.struct(-F.col(precedence), F.col(url))).alias(url))


def ambiguous(claims: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value: an id minted by two keys, or a key with two ids."""
    return claims.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("least"), F.max(value).alias("most")).where("n_values > 1")


def nested_sorted(df: DataFrame, key: str, item: Column, name: str) -> DataFrame:
    """key and the sorted distinct items as an array, whatever the order of the rows."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias(name))


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """The rows that only one side has, with ``side``; empty if both are the same bag of rows."""
    return one.exceptAll(two).withColumn("side", F.lit("left")).unionByName(two.exceptAll(one).withColumn("side", F.lit("right")))
