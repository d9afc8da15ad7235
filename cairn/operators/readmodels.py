"""Read models: joins and groupings over products, placements, solutions and their members."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.member_sets import Sets
from cairn.operators.places import placed_within
from cairn.sources.shared import written


def _ranged_members(products: DataFrame, placements: DataFrame, layers: DataFrame) -> DataFrame:
    """The distinct lane, layer, id, name and l (the lower-case name) of placed products, with the bucket that they lie in:
    buckets are ranges of the display order (l, then id), many per (lane, layer). Written, since their bounds are sampled."""
    n = 4 * int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placements.join(F.broadcast(layers.select("lane", "layer").distinct()), ["lane", "layer"], "left_semi").select("lane", "layer", "id").distinct()
    members = placed.join(products.select("id", "name"), "id").select("lane", "layer", "id", "name", F.lower("name").alias("l")).distinct()
    return written(members.repartitionByRange(n, "lane", "layer", *_display_order()).withColumn("bucket", F.spark_partition_id()))


def _display_order() -> list:
    return [F.col("l").asc_nulls_last(), F.col("id"), F.col("name").asc_nulls_last()]


def map_members(products: DataFrame, placements: DataFrame, layers: DataFrame) -> DataFrame:
    """A row per product of each (lane, layer) of the contract, with its place there in display order, from 1. Places come
    from counts of the buckets and a row number within the bucket, so no task sees all products of a (lane, layer)."""
    ranged = _ranged_members(products, placements, layers)
    counts = ranged.groupBy("lane", "layer", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lane", "layer").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("lane", "layer", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("lane", "layer", "bucket").orderBy(*_display_order()))
    numbered = ranged.withColumn("number", number).join(F.broadcast(before), ["lane", "layer", "bucket"])
    return numbered.select("lane", "layer", (F.col("before") + F.col("number")).alias("place"), "id", "name")


def map_model(products: DataFrame, placements: DataFrame, layers: DataFrame, sep: str = " | ") -> DataFrame:
    """A row per (lane, layer) of the contract, empty ones too: how many products it holds and their names in order.
    products: id, name; placements: id, lane, layer; layers: lane, layer, ord. Names are sorted and joined by bucket; only
    the joined texts of a (lane, layer) meet. That cell grows with the catalog: ``map_members`` has the same as rows."""
    ranged = _ranged_members(products, placements, layers)
    sizes = ranged.groupBy("lane", "layer").agg(F.count_distinct("id").alias("n_products"))
    entry = F.struct("l", F.col("id").alias("i"), F.col("name").alias("n"))
    part = ranged.where("name IS NOT NULL").groupBy("lane", "layer", "bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["n"]), sep).alias("part"))
    names = part.groupBy("lane", "layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "part"))), lambda s: s["part"]), sep).alias("members"))
    placed = sizes.join(names, ["lane", "layer"], "left")
    return F.broadcast(layers).join(placed, ["lane", "layer"], "left").select("lane", "layer", "ord", F.coalesce("n_products", F.lit(0)).alias("n_products"), F.coalesce("members", F.lit("")).alias("members"))


def unplaced(products: DataFrame, placements: DataFrame) -> DataFrame:
    return products.join(placements.select("id").distinct(), "id", "left_anti")


def panel(product: DataFrame, placements: DataFrame, notes: DataFrame, prices: DataFrame) -> DataFrame:
    """Each product with its placements in order and what is known of it; an absent lookup is null, not a missing row."""
    where = placements.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", "lane", "layer"))), ",").alias("placements"))
    return product.join(where, "id", "left").join(notes, "id", "left").join(prices, "id", "left")


def solution_cards(solutions: DataFrame, members: DataFrame, products: DataFrame) -> DataFrame:
    """All solutions with the number of members the catalog knows: null without a composition, 0 if it knows none."""
    known = members.select("solution", "id").distinct().join(products.select("id", F.lit(1).alias("_known")), "id", "left")
    counts = known.groupBy("solution").agg(F.count("_known").alias("member_count"))
    return solutions.join(counts, "solution", "left")


def shared_with(members: DataFrame) -> DataFrame:
    """solution, id and how many other solutions have the product: a count of the product less one, no self-join."""
    pairs = members.select("solution", "id").distinct()
    n = pairs.groupBy("id").agg((F.count("*") - 1).alias("n_shared"))
    return pairs.join(n, "id").select("solution", "id", "n_shared")


def focus_view(members: DataFrame, products: DataFrame, solutions: DataFrame, focus: str | int) -> DataFrame:
    """id, name, other, other_name: the products of one solution with the other solutions that have them too; other is null
    for a product of its own. Products that the catalog lacks are left out, an unknown solution has no rows."""
    pairs = members.select("solution", "id").distinct()
    own = pairs.where(F.col("solution") == focus).select("id").join(products.select("id", "name"), "id")
    others = pairs.where(F.col("solution") != focus).withColumnRenamed("solution", "other").join(solutions.select(F.col("solution").alias("other"), F.col("name").alias("other_name")), "other", "left")
    return own.join(others, "id", "left").select("id", "name", "other", "other_name")


def priced_members(members: DataFrame, pricing: DataFrame) -> DataFrame:
    """The members that have a price."""
    return members.select("solution", "id").distinct().join(pricing.select("id"), "id", "left_semi").select("solution", "id")


def family_bands(products: DataFrame, placements: DataFrame, lane: str, layer: str) -> DataFrame:
    """family_id, place, id, name of one layer's products, sub-grouped by family, in display order within it."""
    placed = placements.where((F.col("lane") == lane) & (F.col("layer") == layer)).select("id").distinct()
    rows = products.join(placed, "id").select("family_id", "id", "name")
    return placed_within(rows, ["family_id"], [F.lower("name"), F.col("id")]).select("family_id", "place", "id", "name")


def panel_sources(products: DataFrame, families: DataFrame, sources: DataFrame) -> DataFrame:
    """id, family_name (the id of an unknown family), and its known sources' titles in the order of source_ids."""
    listed = products.select("id", F.posexplode("source_ids").alias("pos", "source")).join(sources.select(F.col("id").alias("source"), "title"), "source")
    titles = listed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]).alias("titles"))
    named = products.join(families.select(F.col("id").alias("family_id"), F.col("name").alias("_f")), "family_id", "left").join(titles, "id", "left")
    return named.select("id", F.coalesce("_f", "family_id").alias("family_name"), F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))


def shared_solutions(members: DataFrame, focus: int) -> DataFrame:
    """The other solutions that share products with one solution, and how many."""
    pairs = members.select("solution", "id").distinct()
    own = pairs.where(F.col("solution") == focus).select("id")
    return pairs.where(F.col("solution") != focus).join(own, "id", "left_semi").groupBy("solution").agg(F.count("*").alias("n_shared"))


def mirrored_boundaries(boundaries: DataFrame) -> DataFrame:
    """a, b, note in both directions; where both are authored, each keeps its own."""
    both = boundaries.withColumn("pri", F.lit(0)).unionByName(boundaries.select(F.col("b").alias("a"), F.col("a").alias("b"), "note", F.lit(1).alias("pri")))
    return both.groupBy("a", "b").agg(F.min_by("note", F.struct("pri", "note")).alias("note"))


def boundary_overlap(boundaries: DataFrame, members: DataFrame) -> DataFrame:
    """Mirrored boundaries with the number of products that both solutions have; none are dropped."""
    sides = mirrored_boundaries(boundaries)
    both = Sets(members).counts(sides)
    return sides.join(both, ["a", "b"], "left").withColumn("n_common", F.coalesce("n_common", F.lit(0)))


def lens_views(scenarios: DataFrame, compositions: DataFrame) -> DataFrame:
    """Authored scenarios first, then compositions by title: kind, kind_ord, key, title, n_products."""
    return scenarios.select(F.lit("scenario").alias("kind"), F.lit(0).alias("kind_ord"), "key", "title", "n_products").unionByName(
        compositions.select(F.lit("solution").alias("kind"), F.lit(1).alias("kind_ord"), "key", "title", "n_products")
    )


def areas(placements: DataFrame, ord: str) -> DataFrame:
    """The (lane, layer) pairs by first appearance."""
    first = placements.groupBy("lane", "layer").agg(F.min(ord).alias("first_ord"), F.count("*").alias("slots"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("lane").orderBy("first_ord", "layer")))


def radial_layout(members: DataFrame, group: str, order: list[str], width: float, height: float) -> DataFrame:
    """Members on an ellipse from the top, clockwise: rounded x and y, and the side of the label."""
    n = F.count("*").over(Window.partitionBy(group))
    k = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    out = members.withColumn("_a", F.lit(-math.pi / 2) + F.lit(2 * math.pi) * k / n)
    half_up = lambda c: F.floor(c + F.lit(0.5)).cast("long")
    side = F.when(F.cos("_a") > 0.3, "start").when(F.cos("_a") < -0.3, "end").otherwise("middle")
    return out.select(*members.columns, half_up(F.lit(width / 2) + F.lit(0.38 * width) * F.cos("_a")).alias("x"), half_up(F.lit(height / 2) + F.lit(0.36 * height) * F.sin("_a")).alias("y"), side.alias("anchor"))
