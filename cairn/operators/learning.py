"""Read models of learning: cards of products and solutions, lenses, slots, areas, the replay of a journey, selections.

products: id, name, family_id, source_ids; placements: id, lane, layer; members: solution, id; boundaries: a, b, note (as
authored, one way); states: node, status. Lookups that find nothing are null, never a missing row, unless a row is said to
need them. A parameter that names nothing known selects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.dimensions import solution_key
from cairn.operators.member_sets import Sets, both_ways
from cairn.operators.readmodels import mirrored_boundaries

UNVISITED = "unvisited"


def _flag(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.select(F.col(key).alias("id")).distinct().withColumn(name, F.lit(True))


def chips(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``chips``: id and name of each row, in display order. A group is what a card shows; what its names are sorted by is
    made where they are sorted."""
    entry = F.transform(F.collect_set(F.struct("id", "name")), lambda c: F.struct(F.lower(c["name"]).alias("l"), c["id"].alias("id"), c["name"].alias("name")))
    sorted_ = F.transform(F.array_sort(entry), lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name")))
    return rows.groupBy(*keys).agg(sorted_.alias("chips"))


def cards(products: DataFrame, families: DataFrame, sources: DataFrame, roles: DataFrame, notes: DataFrame, pricing: DataFrame, pairs: DataFrame) -> DataFrame:
    """A learning card per product: family_name (its id where unknown), role, note, paired_id and paired_name (null unless
    the catalog has the pair), has_pricing, and titles of its known sources in their order."""
    listed = products.select("id", F.posexplode("source_ids").alias("pos", "source"))
    titles = listed.join(sources.select(F.col("id").alias("source"), "title"), "source").groupBy("id")
    titles = titles.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]).alias("titles"))
    paired = pairs.join(products.select(F.col("id").alias("paired"), F.col("name").alias("paired_name")), "paired").select("id", F.col("paired").alias("paired_id"), "paired_name")
    out = products.join(families.select(F.col("id").alias("family_id"), F.col("name").alias("_family")), "family_id", "left")
    out = out.join(roles.select("id", "role"), "id", "left").join(notes.select("id", "note"), "id", "left").join(paired, "id", "left").join(_flag(pricing, "id", "_priced"), "id", "left").join(titles, "id", "left")
    return out.select(
        "id", "name", F.coalesce("_family", "family_id").alias("family_name"), "role", "note", "paired_id", "paired_name",
        F.coalesce("_priced", F.lit(False)).alias("has_pricing"), F.coalesce("titles", F.array().cast("array<string>")).alias("titles"),
    )


def shared_products(pairs: DataFrame, members: DataFrame, products: DataFrame) -> DataFrame:
    """a, b and ``shared``: the products that both solutions have, as chips in display order; a product that the catalog
    lacks is named by its id."""
    both = Sets(members).ids(pairs)
    named = both.join(products.select("id", "name"), "id", "left").withColumn("name", F.coalesce("name", F.col("id").cast("string")))
    return both_ways(pairs, chips(named, ["a", "b"]).withColumnRenamed("chips", "shared"))


def card_boundaries(solutions: DataFrame, members: DataFrame, products: DataFrame, boundaries: DataFrame) -> DataFrame:
    """solution, neighbour, neighbour_name (its id where unknown), note (the solution's own before a mirrored one) and ``shared``: a row
    per neighbour of either direction, so a solution may have any number of them."""
    bounds = mirrored_boundaries(boundaries).where("a <> b").join(solutions.select(F.col("id").alias("a")), "a", "left_semi")
    names = solutions.select(F.col("id").alias("b"), F.col("name").alias("_name"))
    rows = bounds.join(names, "b", "left").join(shared_products(bounds, members, products), ["a", "b"], "left")
    shared = F.coalesce("shared", F.array().cast(dict(rows.dtypes)["shared"]))
    return rows.select(F.col("a").alias("solution"), F.col("b").alias("neighbour"), F.coalesce("_name", F.col("b").cast("string")).alias("neighbour_name"), "note", shared.alias("shared"))


def card_products(solutions: DataFrame, notes: DataFrame, members: DataFrame, products: DataFrame) -> DataFrame:
    """A row per solution (id, name, summary) with note and ``products``, as chips in display order (null where it has none); a product
    that the catalog lacks is named by its id."""
    named = members.join(products.select("id", "name"), "id", "left").select("solution", "id", F.coalesce("name", F.col("id").cast("string")).alias("name"))
    own = chips(named, ["solution"]).select(F.col("solution").alias("id"), F.col("chips").alias("products"))
    return solutions.join(notes.select("id", "note"), "id", "left").join(own, "id", "left")


def solution_cards(solutions: DataFrame, notes: DataFrame, members: DataFrame, products: DataFrame, boundaries: DataFrame) -> DataFrame:
    """A card per solution (id, name, summary): note, ``products`` and ``boundaries``: neighbours with name, note and what both
    have, in one cell, as a card shows them. ``card_boundaries`` has them as rows, ``card_products`` the rest."""
    entry = F.struct(F.col("neighbour").alias("id"), F.col("neighbour_name").alias("name"), "note", "shared")
    rows = card_boundaries(solutions, members, products, boundaries)
    bound = rows.groupBy(F.col("solution").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("boundaries"))
    return card_products(solutions, notes, members, products).join(bound, "id", "left")


def verified_slots(placements: DataFrame, states: DataFrame) -> DataFrame:
    """One row: slots (placements) in all, and those of verified products; keys of solutions are no products."""
    done = states.where("status = 'verified'").select(F.col("node").alias("id")).distinct().withColumn("_v", F.lit(1))
    rows = placements.withColumn("id", F.col("id").cast("string")).groupBy("id").agg(F.count("*").alias("n")).join(done, "id", "left")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("slots"), F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("n"))), F.lit(0)).alias("verified"))


def composed_solutions(solutions: DataFrame, members: DataFrame) -> DataFrame:
    """The solutions that have a composition: what can be asked for."""
    return solutions.join(members.select(F.col("solution").alias("id")).distinct(), "id", "left_semi")


def statuses(nodes: DataFrame, states: DataFrame, solutions: bool = False) -> DataFrame:
    """nodes (id) with their status, unvisited where there is none; solutions are looked up by their own key."""
    key = solution_key(F.col("id").cast("string")) if solutions else F.col("id").cast("string")
    return nodes.withColumn("node", key).join(states.select("node", "status"), "node", "left").drop("node").withColumn("status", F.coalesce("status", F.lit(UNVISITED)))


def group_counts(products: DataFrame, states: DataFrame, lens: DataFrame) -> DataFrame:
    """family_id, n_unvisited, n_in_lens: how a collapsed group is labelled. lens: id of the lens's products."""
    rows = statuses(products.select("id", "family_id"), states).join(_flag(lens, "id", "_in"), "id", "left")
    return rows.groupBy("family_id").agg(F.count_if(F.col("status") == UNVISITED).alias("n_unvisited"), F.count("_in").alias("n_in_lens"))


def lens_flags(products: DataFrame, lens: DataFrame | None) -> DataFrame:
    """id, in_lens, dimmed: whether the lens has the product; without a lens none is in it and none is dimmed."""
    if lens is None:
        return products.select("id", F.lit(False).alias("in_lens"), F.lit(False).alias("dimmed"))
    rows = products.select("id").join(_flag(lens, "id", "_in"), "id", "left")
    return rows.select("id", F.col("_in").isNotNull().alias("in_lens"), F.col("_in").isNull().alias("dimmed"))


def replay_stops(narration: DataFrame, products: DataFrame) -> DataFrame:
    """The stops (pos, id, caption) of known products with name and family_id; ``stop`` counts them from 1 in order. Stops
    are authored by hand; their numbers come from counts of smaller positions per range."""
    from cairn.operators.places import placed

    known = narration.join(products.select("id", "name", "family_id"), "id")
    return placed(known, ["pos"], "stop").withColumn("stop", F.col("stop") + 1)


def stop_index(raw: Column, total: Column) -> Column:
    """The stop that a parameter names: a whole number from 1 to ``total``; else 1, or 0 where there are no stops."""
    number = F.try_to_number(F.trim(F.coalesce(raw, F.lit("1"))), F.lit("999999999")).cast("int")
    return F.when(total == 0, 0).when(number.between(1, total), number).otherwise(1)


def replay_flags(stops: DataFrame, current: int) -> DataFrame:
    """id, is_current, passed: whether the current stop is the product's, and whether an earlier one is."""
    return stops.groupBy("id").agg(F.max(F.col("stop") == current).alias("is_current"), (F.min("stop") < current).alias("passed"))


def current_stop(stops: DataFrame, current: int) -> DataFrame:
    """The stop of that number; none if it is out of bounds."""
    return stops.where(F.col("stop") == current)


def priced_products(products: DataFrame, pricing: DataFrame) -> DataFrame:
    """id and name of the products with a price, and the number of those without one."""
    rows = products.join(_flag(pricing, "id", "_p"), "id", "left")
    rest = rows.agg(F.count_if(F.col("_p").isNull()).alias("n_unpriced"))
    return rows.where("_p").select("id", "name").crossJoin(F.broadcast(rest))  # one row


def selection(rows: DataFrame, key: str, asked: str | None) -> DataFrame:
    """The rows that a parameter selects: none for an empty or unknown one."""
    return rows.where(F.col(key).cast("string") == asked) if asked else rows.limit(0)


def recall_kind(raw: Column) -> Column:
    return F.when(raw == "practice", "practice").otherwise("verify")


def mode(raw: Column) -> Column:
    return F.when(raw.isin("recall", "replay"), raw).otherwise("explore")


def label_offsets(anchor: Column, y: Column, height: float) -> tuple[Column, Column]:
    """How far a label stands from its node: 18 pixels to its side, above in the upper half and below in the lower."""
    return F.when(anchor == "start", 18).when(anchor == "end", -18).otherwise(0), F.when(y < height / 2, -18).otherwise(30)


def question_at(questions: DataFrame, step: int) -> DataFrame:
    """The boundary question of that number in each solution's session, by neighbour's name; -1 is the step before them. A
    step out of bounds has none."""
    place = F.row_number().over(Window.partitionBy("solution").orderBy("neighbour_name", "neighbour")) - 1
    return questions.withColumn("step", place).where(F.col("step") == step)


def calculator_rows(products: DataFrame, pricing: DataFrame, selected: DataFrame, usage: DataFrame) -> DataFrame:
    """id, metric, is_selected, has_pricing and the metric's amount (0 where there is none). pricing: id, metric; selected:
    id; usage: id, metric, amount."""
    rows = products.select("id").join(_flag(selected, "id", "_s"), "id", "left").join(pricing.select("id", "metric").distinct().withColumn("_p", F.lit(True)), "id", "left")
    rows = rows.join(usage.select("id", "metric", "amount"), ["id", "metric"], "left")
    return rows.select("id", "metric", F.coalesce("_s", F.lit(False)).alias("is_selected"), F.coalesce("_p", F.lit(False)).alias("has_pricing"), F.coalesce("amount", F.lit(0.0)).alias("amount"))
