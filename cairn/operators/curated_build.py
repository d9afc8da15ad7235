"""Building the curated document: normal order of its collections and lists, after its shape and references are checked.

Collections are rows with nested columns, as ``curated.RULES`` names them. Lists whose order means nothing are sorted by
UTF-16 units; tiers, meters, limits, features and the stops of a narration keep the order they were written in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import order_key
from cairn.operators.integrity import CURATED_KEYS
from cairn.operators.places import placed

#: Lists to sort, by collection: column, and the fields to sort by (none: the items themselves).
SORTED = {"products": [("placements", ["lane", "layer"])], "compositions": [("productIds", [])], "scenarios": [("productIds", [])], "learningNotes": [("battlecard", ["competitor"])], "solutionNotes": [("boundariesKo", ["solutionId"])]}
# fixed values: order of the keys of each collection in the written document
GROUNDED = ["sourceUrl", "verifiedAt"]
KEYS = {
    "products": ["productId", "roleKo", "placements", *GROUNDED],
    "compositions": ["solutionId", "productIds", *GROUNDED],
    "pricing": ["productId", "tiers", *GROUNDED],
    "learningNotes": ["productId", "whyKo", "misconceptionKo", "customerQuestionKo", *GROUNDED, "analogyKo", "se", "ae", "battlecard"],
    "solutionNotes": ["solutionId", "oneLinerKo", "whyKo", "misconceptionKo", "customerQuestionKo", *GROUNDED, "boundariesKo", "seAngleKo", "aeAngleKo"],
    "scenarios": ["id", "titleKo", "situationKo", "productIds", *GROUNDED, "talkTrackKo"],
    "narration": ["productId", "captionKo", *GROUNDED],
}


def sorted_list(items: Column, by: list[str]) -> Column:
    """The list by the given fields; equal ones keep their order. Null stays null, repeats stay."""
    keys = lambda x: [order_key(x[f]).alias(f) for f in by] or [order_key(x).alias("key")]
    keyed = F.transform(items, lambda x, i: F.struct(*keys(x), i.alias("_at"), x.alias("_x")))
    return F.transform(F.array_sort(keyed), lambda s: s["_x"])


def normalized(name: str, rows: DataFrame) -> DataFrame:
    """A collection's rows with sorted lists and its keys in the order of the document."""
    for column, by in SORTED.get(name, []):
        if column in rows.columns:
            rows = rows.withColumn(column, sorted_list(F.col(column), by))
    return rows.select(*(["ord"] if "ord" in rows.columns else []), *(c for c in KEYS[name] if c in rows.columns))


def build(curated: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All collections, normalized, with ``ord``: their place by key, and for the narration the place it was written at."""
    out = {}
    for name, rows in curated.items():
        rows = normalized(name, rows)
        if name == "narration":
            out[name] = rows
        else:
            keyed = rows.drop("ord").withColumn("_key", order_key(F.col(CURATED_KEYS[name])))
            out[name] = placed(keyed, ["_key"]).drop("_key")
    return out


def artifact(curated: dict[str, DataFrame], shape: DataFrame, references: DataFrame) -> dict[str, DataFrame]:
    """The built collections; raises if there are shape issues, or else reference issues."""
    from cairn.operators.integrity import gate, two_phases

    gate(two_phases(shape, references), "Curated data")
    return build(curated)
