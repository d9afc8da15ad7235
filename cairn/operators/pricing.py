"""Tiered usage pricing. tiers: product, tier, pos, monthly (null: contact sales); meters: product, tier, mpos, metric,
label, included, per_units, usd; usage: product, metric, amount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import round_cents


def usage_metrics(tiers: DataFrame, meters: DataFrame) -> DataFrame:
    """The metrics of a product with the label of their first appearance, the metric where that has none, and the place of their first appearance (pos, mpos)."""
    at = F.struct("pos", "mpos")
    return meters.join(tiers.select("product", "tier", "pos"), ["product", "tier"]).groupBy("product", "metric").agg(F.min_by(F.coalesce("label", "metric"), at).alias("label"), F.min(at).alias("place"))


def tier_estimates(tiers: DataFrame, meters: DataFrame, usage: DataFrame) -> DataFrame:
    """A row per tier: the rounded sum of its price and its rounded lines, null if the price is null."""
    used = usage.select("product", "metric", "amount")
    lines = meters.join(used, ["product", "metric"], "left")
    over = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), F.coalesce("amount", F.lit(0.0))) - F.col("included"))
    lines = lines.withColumn("line", round_cents(over / F.col("per_units") * F.col("usd")))
    lines = lines.groupBy("product", "tier").agg(F.array_sort(F.collect_list(F.struct("mpos", "line"))).alias("lines"))
    total = F.aggregate(F.coalesce("lines", F.array().cast("array<struct<mpos:int,line:double>>")), F.col("monthly"), lambda acc, x: acc + x["line"])
    return tiers.join(lines, ["product", "tier"], "left").withColumn("total", round_cents(total)).drop("lines")


def uncovered(tiers: DataFrame, meters: DataFrame, usage: DataFrame) -> DataFrame:
    """product, tier, metric of the usage that no meter of the tier covers."""
    asked = usage.where("amount > 0").join(tiers.select("product", "tier"), "product").select("product", "tier", "metric")
    return asked.join(meters.select("product", "tier", "metric"), ["product", "tier", "metric"], "left_anti")


def default_tier(tiers: DataFrame, meters: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """The first tier with meters, else the first. Products without tiers have an empty one if ``products`` names them, else no row."""
    metered = tiers.join(meters.select("product", "tier", F.lit(True).alias("_m")).distinct(), ["product", "tier"], "left")
    found = metered.groupBy("product").agg(F.coalesce(F.min_by(F.when(F.col("_m"), F.col("tier")), F.when(F.col("_m"), F.col("pos"))), F.min_by("tier", "pos")).alias("tier"))
    return found if products is None else products.select("product").distinct().join(found, "product", "left").withColumn("tier", F.coalesce("tier", F.lit("")))


def excluded(selections: DataFrame, estimates: DataFrame) -> DataFrame:
    """The selections (product, tier) that a combined estimate leaves out: their tier has no total, or isn't there."""
    return selections.join(estimates.where("total IS NOT NULL").select("product", "tier"), ["product", "tier"], "left_anti").select("product", "tier")


def combined(selections: DataFrame, estimates: DataFrame) -> DataFrame:
    """One row: the rounded sum of the selected totals, and how many selections have none."""
    found = selections.join(estimates.select("product", "tier", "total"), ["product", "tier"], "left")
    cents = F.sum(F.floor(F.col("total") * 100.0 + 0.5).cast("long"))
    return found.agg((F.coalesce(cents, F.lit(0)).cast("double") / 100.0).alias("total"), F.count_if(F.col("total").isNull()).alias("n_excluded"))


def edits(events: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """The last edit of each key; amounts that are not positive and finite delete it."""
    last = events.groupBy(*keys).agg(F.max_by(value, seq).alias(value))
    return last.where((F.col(value) > 0) & ~F.isnan(value) & (F.col(value) != float("inf")))


def edited(scenarios: DataFrame, events: DataFrame) -> DataFrame:
    """scenario, product, field, value after the edits (scenario, seq, product, field, value): the last edit of a field
    counts. Field ``selected`` chooses a product by true, other fields are its tier and usage; those of products that are
    not chosen are dropped, as are usages that are no positive finite number."""
    rows = scenarios.select("scenario", "product", "field", "value", F.lit(-1).cast("long").alias("seq")).unionByName(events.select("scenario", "product", "field", "value", F.col("seq").cast("long").alias("seq")))
    last = rows.groupBy("scenario", "product", "field").agg(F.max_by("value", "seq").alias("value"))
    chosen = last.where("field = 'selected' AND value = 'true'").select("scenario", "product")
    amount = F.try_to_number("value", F.lit("S999999999999D999999"))
    holds = F.when(F.startswith("field", F.lit("usage.")), F.coalesce(amount > 0, F.lit(False))).otherwise(F.col("value").isNotNull())
    return last.where("field <> 'selected'").where(holds).join(chosen, ["scenario", "product"], "left_semi").unionByName(chosen.select("*", F.lit("selected").alias("field"), F.lit("true").alias("value")))


def calculator_cards(selections: DataFrame, tiers: DataFrame, meters: DataFrame, names: DataFrame) -> DataFrame:
    """pos, product, name, tier of the selected products in their order: the chosen tier, else the default one. selections:
    pos, product, tier (null unless chosen); names: product, name."""
    rows = selections.join(default_tier(tiers, meters).withColumnRenamed("tier", "_d"), "product").join(names, "product", "left")
    return rows.select("pos", "product", F.coalesce("name", F.col("product").cast("string")).alias("name"), F.coalesce("tier", "_d").alias("tier"))
