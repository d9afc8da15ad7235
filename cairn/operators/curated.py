"""Shape checks of curated collections: a flat table of paths and rules, evaluated over nested rows in one projection.

A path steps through fields; ``[]`` goes to each element of a list, ``?`` allows what stands there to be missing. Anything
else that is null breaks its rule. Null and empty lists have no elements, so only rules on the list itself report them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import canonical_url, id_slug, non_blank, unique_list, url_host, utc_instant
from cairn.operators.dimensions import host_of_kind
from cairn.operators.integrity import issues

# fixed values: caps of text fields, least lengths of lists, closed sets
GROUNDED = ["sourceUrl url", "verifiedAt instant"]
RULES = {
    "products": ["productId slug", "roleKo text 200", "placements list 1", "placements distinct", "placements[] layer", *GROUNDED],
    "compositions": ["solutionId slug", "productIds list 1", "productIds distinct", "productIds[] slug", *GROUNDED],
    "pricing": [
        "productId slug", "tiers list 1", "tiers distinct_ids", "tiers[].id slug", "tiers[].name text 80", "tiers[].monthlyUsd? least 0", "tiers[].noteKo? text 200",
        "tiers[].featuresKo? list 1", "tiers[].featuresKo[] text 200", "tiers[].limits? list 1", "tiers[].limits[].metric slug", "tiers[].limits[].included positive",
        "tiers[].limits[].per? one_of day month invocation", "tiers[].limits[].labelKo? text 80", "tiers[].limits[].noteKo? text 200", "tiers[].meters? list 1",
        "tiers[].meters[].metric slug", "tiers[].meters[].included least 0", "tiers[].meters[].per one_of month", "tiers[].meters[].overage.usd positive",
        "tiers[].meters[].overage.perUnits whole", "tiers[].meters[].labelKo? text 80", *GROUNDED,
    ],
    "learningNotes": [
        "productId slug", "whyKo text 400", "misconceptionKo text 400", "customerQuestionKo text 400", "analogyKo? text 400", "se? any archKo opsKo limitsKo", "se?.archKo? text 400",
        "se?.opsKo? text 400", "se?.limitsKo? text 400", "ae? any pitchKo valueKo objections", "ae?.pitchKo? text 400", "ae?.valueKo? text 400", "ae?.objections? list 1 3",
        "ae?.objections[].q text 200", "ae?.objections[].a text 400", "battlecard? list 1", "battlecard[].competitor text 40", "battlecard[].vsKo text 400",
        "battlecard[].grounding one_of official", "battlecard[].sourceUrl url", *GROUNDED,
    ],
    "solutionNotes": [
        "solutionId slug", "oneLinerKo text 200", "whyKo text 400", "misconceptionKo text 400", "customerQuestionKo text 400", "boundariesKo? list 1", "boundariesKo[].solutionId slug",
        "boundariesKo[].noteKo text 400", "seAngleKo? text 400", "aeAngleKo? text 400", *GROUNDED,
    ],
    "scenarios": ["id slug", "titleKo text 80", "situationKo text 400", "productIds list 2", "productIds distinct", "productIds[] slug", "talkTrackKo? text 400", *GROUNDED],
    "narration": ["productId slug", "captionKo text 400", *GROUNDED],
}
# fixed values: the same for the collections of the catalog
ENTITY = ["id slug", "name text 120", "summary text 500", "sourceIds list 1", "sourceIds distinct", "sourceIds[] slug"]
CATALOG_RULES = {
    "sources": ["id slug", "url url", "pageKind one_of marketing-product marketing-solution marketing-overview developer-docs", "title text 200", "retrievedAt instant"],
    "productFamilies": ENTITY, "products": [*ENTITY, "familyId slug"], "solutions": ENTITY, "useCases": ENTITY,
    "relationships": ["type one_of product-solution product-use-case solution-use-case", "fromId slug", "toId slug", "sourceIds list 1", "sourceIds distinct", "sourceIds[] slug"],
}


def predicates(hosts: list[str], layers: dict[str, list[str]]) -> dict[str, Callable[..., Column]]:
    """Each rule's condition; its arguments come from the table as text."""
    fits = lambda x: F.exists(F.array(*(F.struct(F.lit(lane).alias("lane"), F.lit(layer).alias("layer")) for lane, own in layers.items() for layer in own)), lambda p: (p["lane"] == x["lane"]) & (p["layer"] == x["layer"]))
    return {
        "slug": id_slug,
        "text": lambda x, cap: non_blank(x, int(cap)),
        "url": lambda x: canonical_url(x, hosts),
        "instant": utc_instant,
        "list": lambda x, least, most="2147483647": F.size(x).between(int(least), int(most)),
        "distinct": lambda x: unique_list(x, 0) | x.isNull(),
        "distinct_ids": lambda x: unique_list(F.transform(x, lambda y: y["id"]), 0) | x.isNull(),
        "one_of": lambda x, *known: x.isin(*known),
        "any": lambda x, *names: F.coalesce(*(x[n].isNotNull() for n in names)) & F.exists(F.array(*(x[n].isNotNull() for n in names)), lambda y: y),
        "least": lambda x, low: x >= float(low),
        "positive": lambda x: x > 0,
        "whole": lambda x: (x > 0) & (x == F.floor(x)),
        "layer": fits,
    }


def broken(value: Column, at: Column, steps: list[str], holds: Callable[[Column], Column]) -> Column:
    """The paths below ``at`` where the condition doesn't hold, as an array."""
    none = F.array().cast("array<string>")
    if not steps:
        return F.when(F.coalesce(holds(value), F.lit(False)), none).otherwise(F.array(at))
    step, *rest = steps
    name = step.rstrip("[]?")
    if step.endswith("[]"):
        inner = F.transform(value[name], lambda x, i: broken(x, F.concat(at, F.lit(f".{name}["), i.cast("string"), F.lit("]")), rest, holds))
        return F.coalesce(F.flatten(inner), none)
    found = broken(value[name], F.concat(at, F.lit(f".{name}")), rest, holds)
    return F.when(value[name].isNull(), none).otherwise(found) if step.endswith("?") else found


def labelled(paths: Column, rule: str) -> Column:
    """The paths with the rule they break; a layer outside its lane is reported at the layer."""
    suffix = F.lit(".layer" if rule == "layer" else "")
    return F.transform(paths, lambda p: F.struct(F.concat(p, suffix).alias("path"), F.lit(rule).alias("message")))


def shape_issues(rows: DataFrame, name: str, hosts: list[str], layers: dict[str, list[str]], ord: str = "ord", rules: dict[str, list[str]] = RULES) -> DataFrame:
    """The issues (code, path, message, ord) of a collection's rows; message is the rule that is broken. A table of
    nested columns named as in ``rules[name]``, with ``ord`` for its order; other columns are ignored."""
    known = predicates(hosts, layers)
    root, row = F.concat(F.lit(f"{name}["), F.col(ord).cast("string"), F.lit("]")), F.struct(*(c for c in rows.columns if c != ord))
    parts = []
    for line in rules[name]:
        path, rule, *args = line.split()
        found = broken(row, root, path.split("."), lambda x, rule=rule, args=args: known[rule](x, *args))
        parts.append(labelled(found, rule))
    out = rows.select(F.col(ord).alias("_place"), F.explode(F.concat(*parts)).alias("i"))
    return issues(out, "invalid-shape", F.col("i.path"), F.col("i.message"), F.col("_place"))


def coupling_issues(sources: DataFrame, hosts: list[str], docs_host: str, site_host: str, ord: str = "ord") -> DataFrame:
    """Sources on an approved host that is not the one of their kind; other hosts are issues of their URL."""
    host, wanted = url_host(F.col("url")), host_of_kind(F.col("pageKind"), docs_host, site_host)
    wrong = sources.where(F.coalesce(host.isin(*hosts) & (host != wanted), F.lit(False)))
    message = F.concat(F.lit("pageKind '"), "pageKind", F.lit("' requires hostname '"), wanted, F.lit("'"))
    return issues(wrong, "invalid-shape", F.concat(F.lit("sources["), F.col(ord).cast("string"), F.lit("].pageKind")), message, F.col(ord))
