"""Calculator scenarios in query strings: ``products=a,b&t.<product>=<tier>&u.<product>.<metric>=<amount>``.

Unknown products, tiers and metrics, and amounts that are not positive finite decimal numbers, are dropped. Of a repeated
parameter the first counts. Null strings have no scenario.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def query_params(urls: DataFrame, key: str, query: str) -> DataFrame:
    """key, at, name, value of a URL's or query string's parameters, decoded; repeats are dropped within the row, so
    nothing shuffles."""
    text = lambda c: F.coalesce(F.try_url_decode(c), c)
    pairs = F.filter(F.split(F.regexp_replace(query, r"^[^?]*\?|#.*$", ""), "&"), lambda p: F.instr(p, "=") > 1)
    pairs = F.transform(pairs, lambda p: F.struct(text(F.substring_index(p, "=", 1)).alias("name"), text(F.regexp_replace(p, "^[^=]*=", "")).alias("value")))
    rows = urls.select(key, pairs.alias("pairs"))
    first = F.filter("pairs", lambda p, i: F.array_position(F.col("pairs.name"), p["name"]) == i + 1)
    return rows.select(key, F.posexplode(first).alias("at", "p")).select(key, "at", "p.name", "p.value")


def settings(urls: DataFrame, key: str, query: str, tiers: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row per selected product: key, pos, product, tier (null unless chosen) and usage (map of metric to amount).
    tiers: product, tier; metrics: product, metric (strings)."""
    params = query_params(urls, key, query)
    listed = F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "")
    chosen = params.where("name = 'products'").select(key, F.posexplode(F.array_distinct(listed)).alias("pos", "product"))
    chosen = chosen.join(tiers.select("product").distinct(), "product", "left_semi")
    tier = params.where("startswith(name, 't.')").select(key, F.expr("substr(name, 3)").alias("product"), F.col("value").alias("tier")).join(tiers.select("product", "tier").distinct(), ["product", "tier"], "left_semi")
    parts = F.split(F.expr("substr(name, 3)"), r"\.")
    used = params.where("startswith(name, 'u.')").where(F.col("value").rlike(NUMBER)).select(key, "at", F.get(parts, 0).alias("product"), F.get(parts, 1).alias("metric"), F.trim("value").cast("double").alias("amount"))
    used = used.where("amount > 0 AND amount < double('infinity')").join(metrics.select("product", "metric").distinct(), ["product", "metric"], "left_semi")
    used = used.groupBy(key, "product", "metric").agg(F.max_by("amount", "at").alias("amount"))
    usage = used.groupBy(key, "product").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "amount")))).alias("usage"))
    return chosen.join(tier, [key, "product"], "left").join(usage, [key, "product"], "left").select(key, "pos", "product", "tier", F.coalesce("usage", F.create_map().cast("map<string,double>")).alias("usage"))


def serialize(scenarios: DataFrame, key: str) -> DataFrame:
    """key, query: the query string of the rows that ``settings`` returns; products in their order, then tiers, then
    usage. Whole amounts have no decimal point."""
    number = lambda v: F.when((v == F.floor(v)) & (v < 1e15), v.cast("bigint").cast("string")).otherwise(v.cast("string"))
    amounts = F.transform(F.map_entries("usage"), lambda e: F.concat(F.lit("u."), F.col("product"), F.lit("."), e["key"], F.lit("="), number(e["value"])))
    rows = scenarios.select(key, F.struct("pos", "product", F.concat(F.lit("t."), "product", F.lit("="), "tier").alias("t"), amounts.alias("u")).alias("r"))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    names = F.concat(F.lit("products="), F.array_join(F.transform("rows", lambda r: r["product"]), ","))
    chosen = F.filter(F.transform("rows", lambda r: r["t"]), lambda x: x.isNotNull())
    used = F.flatten(F.transform("rows", lambda r: r["u"]))
    return rows.select(key, F.array_join(F.concat(F.array(names), chosen, used), "&").alias("query"))
