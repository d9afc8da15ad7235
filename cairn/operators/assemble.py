"""From claims to a catalog: groups by identity, precedence, unions of sources, and the problems that stop it.

Each entity is one grouping on its key. Values of a field are aggregated by precedence level within the group, so no claim
meets another as a row. ``assembled`` gives all collections and all problems (stage, subject, message); a run that must not
go on with problems passes them to ``require``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.claims import Claims
from cairn.operators.dimensions import ENDPOINTS
from cairn.operators.integrity import document_issues
from cairn.operators.merge import ambiguous
from cairn.operators.places import placed
from cairn.sources.shared import written

#: Texts for what no page states.
FAMILY_SUMMARY = 'Product family "{}" as grouped on the official products overview.'
PRODUCT_SUMMARY = 'Product "{}" as listed on the official products overview.'


class RunError(RuntimeError):
    """The problems of a run, all of them; ``problems`` has rows of stage, subject, message."""

    def __init__(self, problems: list):
        self.problems = problems
        super().__init__("\n".join(f"[{p.stage}] {p.subject}: {p.message}" for p in problems))


def require(problems: DataFrame) -> None:
    """Raises with all problems, in order of stage and subject, if there are any."""
    found = problems.orderBy("stage", "subject", "message").collect()
    if found:
        raise RunError(found)


def _template(text: str, name: str) -> Column:
    before, after = text.split("{}")
    return F.concat(F.lit(before), F.col(name), F.lit(after))


def _problem(rows: DataFrame, subject: Column, message: Column, stage: str = "normalize") -> DataFrame:
    return rows.select(F.lit(stage).alias("stage"), subject.cast("string").alias("subject"), message.alias("message"))


def families(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, name, summary, sourceIds; families of two names are problems and take the smaller."""
    out = claims.groupBy("id").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("source")).alias("sourceIds"))
    return out.select("id", "name", _template(FAMILY_SUMMARY, "name").alias("summary"), "sourceIds"), _problem(ambiguous(claims, "id", "name"), F.concat(F.lit("family "), "id"), F.concat(F.lit("conflicting name: "), "least", F.lit(" and "), "most"))


def entities(claims: DataFrame, key: str, fields: list[str], kind: str, optional: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Entities by key with their fields and sources. claims also have precedence and url of their source. A field is what its
    weightiest claims state, the smallest of several, which are a problem. An entity that lacks a field is a problem, named by
    the url of its weightiest claim, and left out.

    Claims are grouped once by key and level (there are as many levels as kinds of pages), for all fields at once."""
    at = [F.struct(F.min(f).alias("lo"), F.max(f).alias("hi"), F.collect_set(F.when(F.col(f).isNotNull(), F.col("url"))).alias("urls")).alias(f) for f in fields]
    levels = claims.groupBy(key, "precedence").agg(F.min("id").alias("_least"), F.max("id").alias("_most"), F.min("url").alias("_url"), F.collect_set("source").alias("_sources"), *at)
    top = [F.max_by(f, F.when(F.col(f"{f}.lo").isNotNull(), F.col("precedence"))).alias(f"_{f}") for f in fields]
    merged = levels.groupBy(key).agg(F.min("_least").alias("_least"), F.max("_most").alias("_most"), F.max_by("_url", "precedence").alias("_url"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_sources")))).alias("sourceIds"), *top)
    merged = written(merged)  # for the entities and for each sort of problem
    lacks = reduce(lambda a, b: a | b, (F.col(f"_{f}.lo").isNull() for f in fields if f not in optional))
    stated = merged.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_{f}.lo").alias("lo"), F.col(f"_{f}.hi").alias("hi"), F.col(f"_{f}.urls").alias("urls")) for f in fields))).alias("s"))
    problems = _problem(stated.where("s.lo <> s.hi"), F.concat(F.lit(f"{kind} "), key), F.concat(F.lit("conflicting "), "s.field", F.lit(" between "), F.array_join(F.array_sort("s.urls"), " and ")))
    problems = problems.unionByName(_problem(merged.where(lacks), F.concat(F.lit(f"{kind} "), "_least"), F.concat(F.lit("incomplete: "), "_url")))
    if key != "id":
        problems = problems.unionByName(_problem(merged.where("_least <> _most"), F.concat(F.lit(f"{kind} "), key), F.concat(F.lit("key of two ids: "), "_least", F.lit(" and "), "_most")))
        problems = problems.unionByName(_problem(ambiguous(claims, "id", key), F.concat(F.lit(f"{kind} "), "id"), F.concat(F.lit("id of two keys: "), "least", F.lit(" and "), "most")))
    return merged.where(~lacks).select(F.col("_least").alias("id"), *(F.col(f"_{f}.lo").alias(f) for f in fields), "sourceIds"), problems


def enriched(products: DataFrame, docs: DataFrame) -> DataFrame:
    """products with the sources of docs entries whose slug is their id."""
    more = docs.where("slug IS NOT NULL").groupBy(F.col("slug").alias("id")).agg(F.collect_set("source").alias("_more"))
    return products.join(more, "id", "left").withColumn("sourceIds", F.array_sort(F.array_union("sourceIds", F.coalesce("_more", F.array().cast("array<string>"))))).drop("_more")


def relationships(edges: DataFrame, ids: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """type, fromId, toId, sourceIds of distinct edges; edges with an end that the catalog hasn't are problems."""
    out = edges.groupBy("type", F.col("from_id").alias("fromId"), F.col("to_id").alias("toId")).agg(F.array_sort(F.collect_set("source")).alias("sourceIds"))
    # each edge has two ends to look up, in one join with the ids of all collections
    end = lambda field, side: F.struct(F.lit(field).alias("end"), F.element_at(F.create_map(*(F.lit(x) for kind, sides in ENDPOINTS.items() for x in (kind, sides[side]))), F.col("type")).alias("collection"), F.col(field).alias("id"))
    ends = out.select("type", "fromId", "toId", F.inline(F.array(end("fromId", 0), end("toId", 1)))).where("collection IS NOT NULL AND id IS NOT NULL")
    known = reduce(DataFrame.unionByName, (rows.select(F.lit(c).alias("collection"), "id") for c, rows in ids.items())).distinct()
    lost = ends.join(known, ["collection", "id"], "left_anti")
    return out, _problem(lost, F.concat_ws(" ", "type", "fromId", "toId"), F.concat(F.lit("unknown "), "collection", F.lit(" id "), "id"))


def _weighed(claims: Claims) -> Callable[[DataFrame], DataFrame]:
    """Adds the precedence and url of the source to rows of claims."""
    sources = claims.sources.select(F.col("id").alias("source"), "precedence", "url")
    return lambda rows: rows.join(sources, "source")


def _products(claims: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows, problems = entities(claims, "key", ["name", "summary", "family_id"], "product", optional=("summary",))
    return enriched(rows, docs).select("id", "name", F.coalesce("summary", _template(PRODUCT_SUMMARY, "name")).alias("summary"), F.col("family_id").alias("familyId"), "sourceIds"), problems


def _sources(claims: Claims) -> tuple[DataFrame, DataFrame]:
    twice = claims.sources.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("url")), " and ").alias("urls")).where("n > 1")
    rows = claims.sources.select("id", "url", F.col("page_kind").alias("pageKind"), "title", F.col("retrieved_at").alias("retrievedAt"))
    return rows, _problem(twice, F.concat(F.lit("source "), "id"), F.concat(F.lit("claimed by "), "urls"))


def assembled(claims: Claims) -> tuple[dict[str, DataFrame], DataFrame]:
    """The collections of a catalog, and all problems of normalizing and assembling it."""
    tagged = _weighed(claims)
    sources, p0 = _sources(claims)
    fams, p1 = families(claims.families)
    products, p2 = _products(tagged(claims.products), claims.docs)
    solutions, p3 = entities(tagged(claims.solutions), "key", ["name", "summary"], "solution")
    use_cases, p4 = entities(tagged(claims.use_cases), "id", ["name", "summary"], "use case")
    edges, p5 = relationships(claims.edges, {"products": products, "solutions": solutions, "useCases": use_cases})
    problems = [p0, p1, p2, p3, p4, p5, _problem(claims.problems, F.col("url"), F.col("message"))]
    return {"sources": sources, "productFamilies": fams, "products": products, "solutions": solutions, "useCases": use_cases, "relationships": edges}, reduce(DataFrame.unionByName, problems)


def _changed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose rows are not the same bag as before, by digests that are summed up by key."""
    digest = lambda rows, name: rows.groupBy(*keys).agg(F.struct(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(20, 0)")), F.count("*")).alias(name))
    both = digest(before, "_b").join(digest(after, "_a"), keys, "full")
    return written(both.where(~F.col("_b").eqNullSafe(F.col("_a"))).select(*keys))


def refreshed(before: Claims, catalog: dict[str, DataFrame], after: Claims) -> tuple[dict[str, DataFrame], DataFrame, dict[str, DataFrame]]:
    """The catalog of ``after``, its problems, and the keys that were assembled anew for each collection. ``catalog`` is the sound one of
    ``before``. Claims of both are summed up by key; only those of keys whose claims changed are assembled, and take the place of
    what was there. An edge is looked at again if it changed or if an end of it did."""
    was, now = _weighed(before), _weighed(after)

    def spliced(name: str, gone: DataFrame, part: DataFrame) -> DataFrame:
        return catalog[name].join(gone.select("id").distinct(), "id", "left_anti").unionByName(part)

    sources, p0 = _sources(after)
    fams = _changed(before.families, after.families, ["id"])
    part, p1 = families(after.families.join(fams, "id", "left_semi"))
    out = {"sources": sources, "productFamilies": spliced("productFamilies", fams, part)}
    old, new = was(before.products), now(after.products)
    slugs = _changed(before.docs.where("slug IS NOT NULL"), after.docs.where("slug IS NOT NULL"), ["slug"]).select(F.col("slug").alias("id"))
    keys = written(_changed(old, new, ["key"]).union(new.join(slugs, "id", "left_semi").select("key")).distinct())
    part, p2 = _products(new.join(keys, "key", "left_semi"), after.docs)
    gone = written(old.join(keys, "key", "left_semi").select("id").union(new.join(keys, "key", "left_semi").select("id")).distinct())
    out["products"] = spliced("products", gone, part)
    touched, lost, problems = {"productFamilies": fams, "products": keys}, [gone], [p0, p1, p2]
    for name, one, two, key, kind in (("solutions", was(before.solutions), now(after.solutions), "key", "solution"), ("useCases", was(before.use_cases), now(after.use_cases), "id", "use case")):
        keys = _changed(one, two, [key])
        part, found = entities(two.join(keys, key, "left_semi"), key, ["name", "summary"], kind)
        gone = written(one.join(keys, key, "left_semi").select("id").union(two.join(keys, key, "left_semi").select("id")).distinct())
        out[name], touched[name] = spliced(name, gone, part), keys
        lost.append(gone)
        problems.append(found)
    ends = reduce(DataFrame.union, lost).distinct()
    edge = ["type", "from_id", "to_id"]
    keys = _changed(before.edges, after.edges, edge)
    near = reduce(DataFrame.union, (after.edges.join(ends.withColumnRenamed("id", end), end, "left_semi").select(*edge) for end in edge[1:]))
    again = written(after.edges.join(keys.union(near).distinct(), edge, "left_semi"))
    part, found = relationships(again, {name: out[name] for name in ("products", "solutions", "useCases")})
    redone = keys.union(again.select(*edge)).distinct().toDF("type", "fromId", "toId")
    out["relationships"] = catalog["relationships"].join(redone, ["type", "fromId", "toId"], "left_anti").unionByName(part)
    touched["relationships"] = redone
    return out, reduce(DataFrame.unionByName, [*problems, found, _problem(after.problems, F.col("url"), F.col("message"))]), touched


def in_order(catalog: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The collections with ``ord``, their place in the document: by id, edges by type and ends."""
    return {c: placed(rows, ["type", "fromId", "toId"] if c == "relationships" else ["id"]) for c, rows in catalog.items()}


def run(claims: Claims) -> dict[str, DataFrame]:
    """A catalog that is sound: raises with all problems, or with the integrity issues of what was assembled."""
    from cairn.operators.integrity import gate

    catalog, problems = assembled(claims)
    require(problems)
    gate(document_issues(in_order(catalog)))
    return catalog
