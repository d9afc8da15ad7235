"""Integrity checks that emit issues (code, path, message, phase, ord, sub): duplicates, missing references, repeated edges.

Issues come in a fixed order: the phase of the check, the row's place (ord), the place within it (sub). Every check is a
join or a grouping on the key that it tests; none stops at the first issue.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import issue_path
from cairn.operators.dimensions import ENDPOINTS
from cairn.sources.shared import written

# fixed values: how many issues are shown, and the texts of the issues below
MAX_VISIBLE_ISSUES = 10
COLLECTIONS = ("productFamilies", "products", "solutions", "useCases")
CURATED_KEYS = {"products": "productId", "compositions": "solutionId", "pricing": "productId", "learningNotes": "productId", "scenarios": "id", "narration": "productId", "solutionNotes": "solutionId"}

#: Hashes by which rows of one key are counted, the rows beyond which a hash is crowded, and the unknown ids that are broadcast.
HASHES, CROWDED, BROADCAST_ROWS = 65_536, 1_000_000, 500_000


def issues(df: DataFrame, code: str, path: Column, message: Column, ord: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), path.alias("path"), message.alias("message"), ord.cast("long").alias("ord"))


def duplicate_keys(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every second and later row of a key, with ``occurrence``."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("occurrence > 1")


def later_rows(df: DataFrame, keys: list[str], ord: str = "ord") -> DataFrame:
    """Every row of a key but its first by ``ord``; of rows that share the first place all but one. Rows travel once, to be numbered
    by key. Where a hash of keys is in very many rows, the firsts are aggregated before rows meet them, so no key is sorted there."""
    df = df.where(F.col(ord).isNotNull() & reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    hashed = df.withColumn("_h", F.pmod(F.xxhash64(*keys), F.lit(HASHES)).cast("int"))
    crowded = F.broadcast(hashed.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED).select("_h"))  # a row per hash at most
    alone = hashed.join(crowded, "_h", "left_anti").drop("_h")
    alone = alone.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(ord))).where("_k > 1").drop("_k")
    many = hashed.join(crowded, "_h", "left_semi").drop("_h")
    first = many.groupBy(*keys).agg(F.min(ord).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = many.join(first, keys)
    tied = rows.where(F.col(ord) == F.col("_first")).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(ord))).where("_k > 1").drop("_k")
    return alone.unionByName(rows.where(F.col(ord) > F.col("_first")).unionByName(tied).drop("_first"))


def missing_references(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The children whose non-null key no parent has."""
    known = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(known, child_key, "left_anti")


def collisions(one: DataFrame, two: DataFrame, a: str, b: str) -> DataFrame:
    """The keys that both collections use."""
    return one.select(F.col(a).alias("id")).distinct().join(two.select(F.col(b).alias("id")).distinct(), "id", "left_semi")


def report(parts: list[DataFrame]) -> DataFrame:
    """All issues with ``phase``, the position of the check that made them."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn("phase", F.lit(k)) for k, p in enumerate(parts)))


def summary(issue_rows: DataFrame) -> DataFrame:
    return issue_rows.groupBy("code").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


def visible(issue_rows: DataFrame, most: int = MAX_VISIBLE_ISSUES) -> DataFrame:
    """The first issues in order, each with the number of those not shown."""
    shown = issue_rows.orderBy("phase", "ord", "path").limit(most)
    hidden = issue_rows.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("hidden"))
    return shown.crossJoin(F.broadcast(hidden))  # one row


def _at(collection: str, field: str, sub: Column | None = None, inner: str = "") -> Column:
    """collection[ord].field, or collection[ord].field[sub].inner."""
    path = F.concat(F.lit(f"{collection}["), F.col("ord").cast("string"), F.lit(f"]{'.' if field else ''}{field}"))
    return path if sub is None else F.concat(path, F.lit("["), sub.cast("string"), F.lit(f"]{'.' if inner else ''}{inner}"))


def _quoted(before: str, value: Column | str, after: str = "") -> Column:
    return F.concat(F.lit(f"{before} '"), value, F.lit(f"'{after}"))


def _rows(df: DataFrame, code: str, path: Column, message: Column, sub: Column | None = None) -> DataFrame:
    return issues(df, code, path, message, F.col("ord")).withColumn("sub", F.lit(0).cast("long")) if sub is None else df.select(
        F.lit(code).alias("code"), path.alias("path"), message.alias("message"), F.col("ord").cast("long").alias("ord"), sub.cast("long").alias("sub")
    )


def _unknown(rows: DataFrame, key: str, known: DataFrame, kind: str, path: Column, sub: Column | None = None, code: str = "unknown-entity-reference") -> DataFrame:
    return _rows(missing_references(rows, known, key, "id"), code, path, _quoted(f"Unknown {kind} id", key), sub)


def document_issues(catalog: dict[str, DataFrame]) -> DataFrame:
    """All issues of a catalog's collections: repeated ids, unknown sources, unknown families, unknown ends of edges, and
    repeated edges. Collections have ord and id, entities also sourceIds, products familyId, relationships type, fromId and
    toId. One id in two collections is no issue."""
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    phase = {c: k for k, c in enumerate(("sources", *COLLECTIONS))}
    named = lambda c: F.lit(c).alias("c")
    ids = union(catalog[c].select(named(c), F.lit(k).alias("phase"), F.col("ord").cast("long").alias("ord"), "id") for c, k in phase.items())
    at = lambda field, *inner: F.concat("c", F.lit("["), F.col("ord").cast("string"), F.lit(f"]{'.' if field else ''}{field}"), *inner)
    issue = lambda rows, code, path, message: rows.select(F.lit(code).alias("code"), path.alias("path"), message.alias("message"), F.col("ord").cast("long").alias("ord"), F.col("sub").cast("long").alias("sub"), "phase")
    zero = F.lit(0).alias("sub")
    twice = issue(later_rows(ids, ["c", "id"]).select("*", zero), "duplicate-id", at("id"), F.concat(_quoted("Duplicate id", "id", " in "), "c"))
    # whatever refers to a source, in one join
    used = union(catalog[c].select(named(c), F.lit(len(phase) + k).alias("phase"), "ord", F.posexplode("sourceIds").alias("sub", "source")) for k, c in enumerate((*COLLECTIONS, "relationships")))
    unsourced = issue(missing_references(used, catalog["sources"], "source", "id"), "unknown-source-reference", at("sourceIds", F.lit("["), F.col("sub").cast("string"), F.lit("]")), _quoted("Unknown source id", "source"))
    # and whatever refers to an entity in another: a row for each end of an edge, one for a product's family
    last = 2 * len(phase)
    side = lambda field, k: F.struct(F.lit(k).alias("sub"), F.lit(field).alias("field"), F.coalesce(*(F.when(F.col("type") == kind, sides[k]) for kind, sides in ENDPOINTS.items())).alias("to"), F.col(field).alias("id"))
    ends = catalog["relationships"].select(named("relationships"), F.lit(last + 1).alias("phase"), "ord", F.inline(F.array(side("fromId", 0), side("toId", 1))))
    family = catalog["products"].select(named("products"), F.lit(last).alias("phase"), "ord", zero, F.lit("familyId").alias("field"), F.lit("productFamilies").alias("to"), F.col("familyId").alias("id"))
    known = ids.where("c <> 'sources'").select(F.col("c").alias("to"), "id").distinct()
    # ids are looked up once each, however many rows name them; rows then meet the unknown ones
    refs = ends.unionByName(family).where("id IS NOT NULL AND to IS NOT NULL")
    lost_ids = written(refs.select("to", "id").distinct().join(known, ["to", "id"], "left_anti"))
    lost = refs.join(F.broadcast(lost_ids) if lost_ids.count() <= BROADCAST_ROWS else lost_ids, ["to", "id"])
    unknown = issue(lost, "unknown-entity-reference", at("", F.lit("."), "field"), F.concat(F.lit("Unknown "), "to", _quoted(" id", "id")))
    again = later_rows(catalog["relationships"].select(named("relationships"), F.lit(last + 1).alias("phase"), F.col("ord").cast("long").alias("ord"), "type", "fromId", "toId", F.lit(2).alias("sub")), ["type", "fromId", "toId"])
    repeated = issue(again, "duplicate-relationship", at(""), F.concat(_quoted("Duplicate relationship", "type"), _quoted(" from", "fromId"), _quoted(" to", "toId")))
    return union([twice, unsourced, unknown, repeated])


def curated_issues(curated: dict[str, DataFrame]) -> DataFrame:
    """Repeated keys of the curated collections, in the order of the document."""
    return report([_rows(later_rows(curated[c], [key]), "duplicate-id", _at(c, key), _quoted(f"Duplicate {key}", key, f" in {c}")) for c, key in CURATED_KEYS.items()])


def curated_reference_issues(curated: dict[str, DataFrame], products: DataFrame, solutions: DataFrame, known_collisions: list[str]) -> DataFrame:
    """What the curated collections refer to and the catalog hasn't, scenarios that share an id with a solution, solutions
    that bound themselves, and product ids that became solution ids without being known as such."""
    def own(c: str, key: str, known: DataFrame, kind: str) -> DataFrame:
        return _unknown(curated[c], key, known, kind, _at(c, key), F.lit(-1))

    def listed(c: str) -> DataFrame:
        return _unknown(curated[c].select("ord", F.posexplode("productIds").alias("sub", "product")), "product", products, "products", _at(c, "productIds", F.col("sub")), F.col("sub"))

    bounds = curated["solutionNotes"].select("ord", "solutionId", F.posexplode("boundariesKo").alias("sub", "b")).select("ord", "solutionId", "sub", F.col("b.solutionId").alias("other"))
    at = _at("solutionNotes", "boundariesKo", F.col("sub"), "solutionId")
    known = solutions.select("id").distinct()
    shared = curated["scenarios"].join(known, "id", "left_semi")
    both = known.join(products.select("id").distinct(), "id", "left_semi").where(~F.col("id").isin(*known_collisions))
    parts = [
        [own("products", "productId", products, "products")],
        [own("compositions", "solutionId", solutions, "solutions"), listed("compositions")],
        [own("pricing", "productId", products, "products")],
        [own("learningNotes", "productId", products, "products")],
        [_rows(shared, "duplicate-id", _at("scenarios", "id"), _quoted("Scenario id", "id", " collides with a solution id"), F.lit(-1)), listed("scenarios")],
        [own("narration", "productId", products, "products")],
        [own("solutionNotes", "solutionId", solutions, "solutions"), _unknown(bounds, "other", solutions, "solutions", at, 2 * F.col("sub")),
         _rows(bounds.where("other = solutionId"), "duplicate-id", at, _quoted("Solution", "solutionId", " cannot bound itself"), 2 * F.col("sub") + 1)],
        [both.select(F.lit("duplicate-id").alias("code"), F.concat(F.lit("catalog.solutions["), "id", F.lit("]")).alias("path"), _quoted("New id of a product and a solution", "id").alias("message"), F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("sub"))],
    ]
    return report([reduce(DataFrame.unionByName, p) for p in parts])


def two_phases(shape: DataFrame, integrity: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """The shape issues; if there are none, the integrity issues, which need well-formed rows. A function that makes the latter is
    called only then."""
    if callable(integrity):
        own = shape if "sub" in shape.columns else shape.withColumn("sub", F.lit(None).cast("long"))
        return own.unionByName(integrity()) if shape.isEmpty() else own
    clean = shape.agg((F.count("*") == 0).alias("_clean"))
    return shape.unionByName(integrity.crossJoin(F.broadcast(clean)).where("_clean").drop("_clean"), allowMissingColumns=True)  # one row


def catalog_issues(products: DataFrame, families: DataFrame, edges: DataFrame, product: str, family: str, family_id: str, source: str, target: str) -> DataFrame:
    """Duplicate product ids, products of unknown families, and repeated edges, as one report."""
    orphan = missing_references(products, families, family, family_id)
    text = lambda *cols: F.concat_ws(" ", *(F.col(c).cast("string") for c in cols))
    return report([
        issues(later_rows(products, [product]), "duplicate-id", issue_path("products", F.col("ord"), "id"), text(product), F.col("ord")),
        issues(orphan, "unknown-entity-reference", issue_path("products", F.col("ord"), "familyId"), text(family), F.col("ord")),
        issues(later_rows(edges, [source, target]), "duplicate-relationship", _at("relationships", ""), text(source, target), F.col("ord")),
    ])


class ValidationError(ValueError):
    """A document with issues; ``issues`` has all of them in order."""

    def __init__(self, issues: list, subject: str):
        self.issues = issues
        super().__init__("\n".join([f"{subject} validation failed with {len(issues)} issue(s):", *(f"  {i.path}: {i.message}" for i in issues)]))


def gate(issue_rows: DataFrame, subject: str = "Catalog") -> None:
    """Raises if there are issues, with a line for each. For documents that a person mends; use ``visible`` for large ones."""
    order = [c for c in ("phase", "ord", "sub", "path") if c in issue_rows.columns]
    found = issue_rows.orderBy(*order).collect()
    if found:
        raise ValidationError(found, subject)
