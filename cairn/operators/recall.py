"""Recall sessions: pools of answers and decoys, prefix suggestions, scores and what they do to a record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.operators.learning import shared_products
from cairn.operators.places import first_within
from cairn.operators.readmodels import mirrored_boundaries
from cairn.sources.shared import written


def adjacent_layers(layers: DataFrame) -> DataFrame:
    """lane, layer, near: the layers before and after each in its lane."""
    order = Window.partitionBy("lane").orderBy("ord")
    sides = layers.withColumn("_a", F.lag("layer").over(order)).withColumn("_b", F.lead("layer").over(order))
    both = sides.select("lane", "layer", F.explode(F.array("_a", "_b")).alias("near"))
    return both.where("near IS NOT NULL")


def recall_pool(products: DataFrame, placements: DataFrame, layers: DataFrame, share: float = 0.3, least: int = 2) -> DataFrame:
    """lane, layer, id, name, is_answer: the answers of each layer, and decoys from adjacent layers: the first
    max(2, 30 % of the answers) in display order that are no answers. A layer without answers has two decoys. Placed ids
    that no product has are neither."""
    placed = placements.select("lane", "layer", "id").distinct().join(products.select("id", "name"), "id")
    near = adjacent_layers(layers).join(placed.withColumnRenamed("layer", "near"), ["lane", "near"]).select("lane", "layer", "id", "name").distinct()
    decoys = near.join(placed, ["lane", "layer", "id"], "left_anti")
    n = placed.groupBy("lane", "layer").agg(F.greatest(F.lit(least), F.floor(F.count("*") * share + 0.5).cast("int")).alias("k"))
    n = near.select("lane", "layer").distinct().join(n, ["lane", "layer"], "left").select("lane", "layer", F.coalesce("k", F.lit(least)).alias("k"))
    decoys = first_within(decoys, ["lane", "layer"], [F.lower("name"), F.col("id")], n)
    cols = ["lane", "layer", "id", "name"]
    return placed.select(*cols, F.lit(True).alias("is_answer")).unionByName(decoys.select(*cols, F.lit(False).alias("is_answer")))


def suggest(products: DataFrame, query: str, entered: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """Products of which a word of the name or id starts with the query; a query under three letters must be a name or
    id. Entered ones are left out; at most ``limit``, in display order."""
    q = query.strip().lower()
    if not q:
        found = products.limit(0)
    elif len(q) < 3:
        found = products.where((F.lower("name") == q) | (F.col("id").cast("string") == q))
    else:
        begins = lambda text, sep: F.exists(F.split(F.lower(text), sep), lambda w: w.startswith(q))
        found = products.where(begins(F.col("name"), r"[\s/-]+") | begins(F.col("id").cast("string"), "-"))
    if entered is not None:
        found = found.join(entered.select("id"), "id", "left_anti")
    return found.orderBy(F.lower("name"), "id").limit(limit)


def search_index(products: DataFrame, letters: int = 3) -> DataFrame:
    """The words of names and ids by their first letters, once for any number of searches: _begins, _word, id, name. Written in order
    of these, so that a search for few texts skips most of it."""
    words = F.array_distinct(F.concat(F.split(F.lower("name"), r"[\s/-]+"), F.split(F.lower(F.col("id").cast("string")), "-")))
    rows = products.select("id", "name", F.explode(words).alias("_word")).where(F.length("_word") >= letters)
    rows = rows.withColumn("_begins", F.substring("_word", 1, letters))
    return written(rows.repartitionByRange("_begins", "_word", "id").sortWithinPartitions("_begins", "_word"))


def suggest_all(index: DataFrame, products: DataFrame, queries: DataFrame, limit: int = 8, letters: int = 3) -> DataFrame:
    """query, place, id, name: what ``suggest`` gives for each row of queries (query, text), by the index of ``search_index``. A
    text is searched once, however many queries have it."""
    asked = queries.select("query", F.lower(F.trim("text")).alias("_q")).where(F.length("_q") > 0)
    texts = asked.select("_q").distinct()
    long = texts.where(F.length("_q") >= letters).withColumn("_begins", F.substring("_q", 1, letters))
    begun = long.join(index, "_begins").where(F.startswith("_word", F.col("_q"))).select("_q", "id", "name").distinct()
    short = texts.where(F.length("_q") < letters)
    exact = [short.join(products.select(by.alias("_q"), "id", "name"), "_q").select("_q", "id", "name") for by in (F.lower("name"), F.col("id").cast("string"))]
    found = first_within(begun.unionByName(reduce(DataFrame.unionByName, exact).distinct()), ["_q"], [F.lower("name"), F.col("id")], limit)
    return asked.join(found, "_q").select("query", "place", "id", "name")


def pool_answers(solutions: DataFrame, members: DataFrame, products: DataFrame) -> DataFrame:
    """The answers (solution, id, name) of every solution that has a composition."""
    named = members.distinct().join(products.select("id", "name"), "id", "left").join(solutions.select(F.col("id").alias("solution")), "solution", "left_semi")
    return named.select("solution", "id", F.coalesce("name", F.col("id").cast("string")).alias("name"))


def pool_questions(solutions: DataFrame, members: DataFrame, products: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Boundary questions: solution, neighbour, neighbour_name and answers, for each neighbour of either direction with which a
    solution shares products."""
    sides = mirrored_boundaries(boundaries).where("a <> b").select("a", "b").join(solutions.select(F.col("id").alias("a")), "a", "left_semi")
    asked = shared_products(sides, members, products).join(solutions.select(F.col("id").alias("b"), F.col("name").alias("_n")), "b", "left")
    return asked.select(F.col("a").alias("solution"), F.col("b").alias("neighbour"), F.coalesce("_n", F.col("b").cast("string")).alias("neighbour_name"), F.col("shared").alias("answers"))


def solution_pools(solutions: DataFrame, members: DataFrame, products: DataFrame, boundaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The answers of every solution and its boundary questions."""
    return pool_answers(solutions, members, products), pool_questions(solutions, members, products, boundaries)


def results(answers: DataFrame, picked: DataFrame) -> DataFrame:
    """area, id, correct: a row per answer."""
    return answers.select("area", "id").distinct().join(picked.select("area", "id").distinct().withColumn("_p", F.lit(True)), ["area", "id"], "left").select("area", "id", F.col("_p").isNotNull().alias("correct"))


def score(answers: DataFrame, picked: DataFrame) -> DataFrame:
    """area: n_answers, n_correct, n_wrong, kind. answers: area, id; picked: area, id. More wrong than right picks make a
    session practice."""
    both = answers.withColumn("_a", F.lit(1)).join(picked.distinct().withColumn("_p", F.lit(1)), ["area", "id"], "full")
    counts = both.groupBy("area").agg(F.count("_a").alias("n_answers"), F.count_if(F.col("_a").isNotNull() & F.col("_p").isNotNull()).alias("n_correct"), F.count_if(F.col("_a").isNull()).alias("n_wrong"))
    return counts.withColumn("kind", F.when(F.col("n_wrong") > F.col("n_correct"), "practice").otherwise("verify"))


def compose_effect(correct: str = "n_correct", total: str = "n_answers", wrong: str = "n_wrong", threshold: float = 0.8) -> Column:
    """none for a spray of picks, verify from the threshold on, else demote."""
    return F.when(F.col(wrong) > F.col(correct), "none").when(F.coalesce(F.try_divide(correct, total) >= threshold, F.lit(False)), "verify").otherwise("demote")


def boundary_effect(correct: str = "n_correct", total: str = "n_answers", wrong: str = "n_wrong") -> Column:
    """demote for any miss or wrong entry; a perfect answer changes nothing."""
    return F.when((F.col(wrong) > 0) | (F.col(correct) < F.col(total)), "demote").otherwise("none")


def picks(toggles: DataFrame, answers: DataFrame, session: tuple[str, ...] = ("area",)) -> DataFrame:
    """*session, id: what is picked in each session after its toggles (*session, seq, id) in order of seq, then id. A toggle removes a
    pick that is there; else it adds one while there are fewer picks than its area has answers (area, id). Areas without answers
    have no picks, and a null id is none.

    A session that toggles no more ids than there is room for never runs out of it: there an id is picked if it was toggled an odd
    number of times, by counts alone. Only sessions with more ids are folded in order, each as a stream of sorted rows in one task
    that holds no more than the picks of the moment."""
    keys = list(session)
    room = answers.groupBy("area").agg(F.count_distinct("id").cast("int").alias("_room"))
    clicks = toggles.where("id IS NOT NULL").join(room, "area").select(*keys, "seq", "id", "_room")
    times = written(clicks.groupBy(*keys, "id", "_room").agg(F.count("*").alias("_n")))
    full = written(times.groupBy(*keys, "_room").agg(F.count("*").alias("_ids")).where("_ids > _room"))
    same = lambda one: reduce(lambda x, y: x & y, (one[k].eqNullSafe(full[k]) for k in keys))
    free = times.join(full, same(times), "left_anti").where("_n % 2 = 1").select(*keys, "id")
    rows = clicks.join(full, same(clicks), "left_semi")
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "seq", "id").select(*keys, "id", "_room")
    return free.unionByName(ordered.mapInArrow(_folded(free.schema), free.schema))


def _folded(schema: StructType):
    """The fold over batches of rows (*session, id, room) that are sorted by session."""

    def fold(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        fields, now, held = to_arrow_schema(schema), None, {}
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
        for batch in batches:
            done = []
            for *key, x, room in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if key != now:
                    done += [(*now, one) for one in held]
                    now, held = key, {}
                if x in held:
                    del held[x]
                elif len(held) < room:
                    held[x] = True
            if done:
                yield made(done)
        if held:
            yield made([(*now, one) for one in held])

    return fold


def entered_chips(entered: DataFrame, products: DataFrame) -> DataFrame:
    """entered (area, id) with the product's name, its id where the catalog lacks it."""
    return entered.join(products.select("id", "name"), "id", "left").withColumn("name", F.coalesce("name", F.col("id").cast("string")))
