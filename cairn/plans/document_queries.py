"""Registered queries of catalog documents, learning and progress, on the tables at hand, each with its SQL.

Roles: source = nation, family = p_brand, product = part, solution = supplier, use case = c_mktsegment, edge = lineitem,
claim = order, learner's event = events. Ids are texts made from keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import assemble, claims, curated_build, integrity
from cairn.plans.registry import query, t
from cairn.sources import page_parsers

SITE, DOCS = "site.example.net", "docs.example.net"


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# catalog documents ----------------------------------------------------------------------------------------------------
def _catalog(s, d) -> dict[str, DataFrame]:
    part, line = t(s, d, "part"), t(s, d, "lineitem")
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    named = F.array(_id("nation-", "p_size"), _id("nation-", "p_partkey"))
    families = part.where("p_size > 45").groupBy(brand.alias("id")).agg(F.min("p_partkey").alias("ord"), F.array(F.concat(F.lit("nation-"), F.max("p_size").cast("string"))).alias("sourceIds"))
    edges = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_linestatus") == "F", "product-solution").when(F.col("l_returnflag") == "A", "product-use-case").otherwise("solution-use-case").alias("type"),
        F.when((F.col("l_linestatus") == "F") | (F.col("l_returnflag") == "A"), _id("part-", "l_partkey")).otherwise(_id("supplier-", "l_suppkey")).alias("fromId"),
        F.when(F.col("l_linestatus") == "F", _id("supplier-", "l_suppkey")).otherwise(F.concat(F.lit("segment-"), F.col("l_linenumber").cast("string"))).alias("toId"), F.array(_id("nation-", "l_linenumber")).alias("sourceIds"),
    )
    return {
        "sources": t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), _id("nation-", "n_nationkey").alias("id")),
        "productFamilies": families,
        "products": part.select(F.col("p_partkey").alias("ord"), _id("part-", "p_partkey").alias("id"), brand.alias("familyId"), named.alias("sourceIds")),
        "solutions": t(s, d, "supplier").select(F.col("s_suppkey").alias("ord"), _id("supplier-", "s_nationkey").alias("id"), F.array(_id("nation-", "s_nationkey")).alias("sourceIds")),
        "useCases": t(s, d, "customer").groupBy("c_mktsegment").agg(F.min("c_nationkey").alias("n"), F.min("c_custkey").alias("ord")).select("ord", _id("segment-", "n").alias("id"), F.array().cast("array<string>").alias("sourceIds")),
        "relationships": edges,
    }


_DOC = """
    WITH src AS (SELECT n_nationkey::BIGINT AS ord, 'nation-' || n_nationkey AS id FROM nation),
    fam AS (SELECT lower(replace(p_brand, '#', '-')) AS id, min(p_partkey) AS ord, ['nation-' || max(p_size)] AS s FROM part WHERE p_size > 45 GROUP BY 1),
    pro AS (SELECT p_partkey AS ord, 'part-' || p_partkey AS id, lower(replace(p_brand, '#', '-')) AS f, ['nation-' || p_size, 'nation-' || p_partkey] AS s FROM part),
    sol AS (SELECT s_suppkey AS ord, 'supplier-' || s_nationkey AS id, ['nation-' || s_nationkey] AS s FROM supplier),
    uc AS (SELECT min(c_custkey) AS ord, 'segment-' || min(c_nationkey) AS id FROM customer GROUP BY c_mktsegment),
    rel AS (SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_linestatus = 'F' THEN 'product-solution' WHEN l_returnflag = 'A' THEN 'product-use-case' ELSE 'solution-use-case' END AS type,
        CASE WHEN l_linestatus = 'F' OR l_returnflag = 'A' THEN 'part-' || l_partkey ELSE 'supplier-' || l_suppkey END AS a, CASE WHEN l_linestatus = 'F' THEN 'supplier-' || l_suppkey ELSE 'segment-' || l_linenumber END AS b, ['nation-' || l_linenumber] AS s FROM lineitem),
    ref AS (SELECT 5 AS phase, 'productFamilies' AS c, ord, s FROM fam UNION ALL SELECT 6, 'products', ord, s FROM pro UNION ALL SELECT 7, 'solutions', ord, s FROM sol UNION ALL SELECT 9, 'relationships', ord, s FROM rel),
    ids AS (SELECT 0 AS phase, 'sources' AS c, ord, id FROM src UNION ALL SELECT 1, 'productFamilies', ord, id FROM fam UNION ALL SELECT 2, 'products', ord, id FROM pro UNION ALL SELECT 3, 'solutions', ord, id FROM sol UNION ALL SELECT 4, 'useCases', ord, id FROM uc),
    dup AS (SELECT *, row_number() OVER (PARTITION BY phase, id ORDER BY ord) AS n FROM ids), edge AS (SELECT *, row_number() OVER (PARTITION BY type, a, b ORDER BY ord) AS n FROM rel),
    i AS (SELECT 'duplicate-id' AS code, c || '[' || ord || '].id' AS path, 'Duplicate id ''' || id || ''' in ' || c AS message, phase, ord, 0 AS sub FROM dup WHERE n > 1
        UNION ALL SELECT 'unknown-source-reference', c || '[' || ord || '].sourceIds[' || k || ']', 'Unknown source id ''' || x || '''', phase, ord, k FROM (SELECT phase, c, ord, unnest(s) AS x, unnest(range(len(s))) AS k FROM ref) WHERE x NOT IN (SELECT id FROM src)
        UNION ALL SELECT 'unknown-entity-reference', 'products[' || ord || '].familyId', 'Unknown productFamilies id ''' || f || '''', 10, ord, 0 FROM pro WHERE f NOT IN (SELECT id FROM fam)
        UNION ALL SELECT 'unknown-entity-reference', 'relationships[' || ord || '].fromId', 'Unknown products id ''' || a || '''', 11, ord, 0 FROM rel WHERE type <> 'solution-use-case' AND a NOT IN (SELECT id FROM pro)
        UNION ALL SELECT 'unknown-entity-reference', 'relationships[' || ord || '].fromId', 'Unknown solutions id ''' || a || '''', 11, ord, 0 FROM rel WHERE type = 'solution-use-case' AND a NOT IN (SELECT id FROM sol)
        UNION ALL SELECT 'unknown-entity-reference', 'relationships[' || ord || '].toId', 'Unknown solutions id ''' || b || '''', 11, ord, 1 FROM rel WHERE type = 'product-solution' AND b NOT IN (SELECT id FROM sol)
        UNION ALL SELECT 'unknown-entity-reference', 'relationships[' || ord || '].toId', 'Unknown useCases id ''' || b || '''', 11, ord, 1 FROM rel WHERE type <> 'product-solution' AND b NOT IN (SELECT id FROM uc)
        UNION ALL SELECT 'duplicate-relationship', 'relationships[' || ord || ']', 'Duplicate relationship ''' || type || ''' from ''' || a || ''' to ''' || b || '''', 11, ord, 2 FROM edge WHERE n > 1)"""


@query(_DOC + " SELECT * FROM i")
def catalog_document_issues(s, d):
    return integrity.document_issues(_catalog(s, d))


@query(_DOC + " SELECT c AS collection, count(*) AS n FROM (SELECT c FROM ids UNION ALL SELECT 'relationships' FROM rel) GROUP BY 1")
def collection_counts(s, d):
    from functools import reduce

    return reduce(DataFrame.unionByName, (rows.agg(F.lit(c).alias("collection"), F.count("*").alias("n")) for c, rows in _catalog(s, d).items()))


def _curated(s, d) -> dict[str, DataFrame]:
    part, sup = t(s, d, "part"), t(s, d, "supplier")
    parts = t(s, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("ids"))
    listed = F.transform("ids", lambda x: F.concat(F.lit("part-"), x.cast("string")))
    bounds = F.array(*(F.struct(_id("supplier-", c).alias("solutionId"), F.col("s_name").alias("noteKo")) for c in ("s_nationkey", "s_suppkey")))
    own = lambda rows, key, c: rows.select(F.col(c).cast("long").alias("ord"), _id("part-", c).alias(key))
    return {
        "products": part.select(F.col("p_partkey").alias("ord"), _id("part-", "p_size").alias("productId")),
        "compositions": parts.select(F.col("l_suppkey").alias("ord"), _id("supplier-", "l_suppkey").alias("solutionId"), listed.alias("productIds")),
        "pricing": own(part.where("p_retailprice > 915"), "productId", "p_partkey"), "learningNotes": own(t(s, d, "orders"), "productId", "o_orderkey"), "narration": own(t(s, d, "customer"), "productId", "c_custkey"),
        "scenarios": t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), _id("supplier-", "n_nationkey").alias("id"), F.array(_id("part-", "n_nationkey"), _id("none-", "n_nationkey")).alias("productIds")),
        "solutionNotes": sup.select(F.col("s_suppkey").alias("ord"), _id("supplier-", "s_nationkey").alias("solutionId"), bounds.alias("boundariesKo")),
    }


def _known(s, d):
    big = t(s, d, "part").where("p_size > 5").select(_id("part-", "p_partkey").alias("id"))
    return big.unionByName(t(s, d, "region").select(_id("supplier-", "r_regionkey").alias("id"))), t(s, d, "supplier").where("s_acctbal > 0").select(_id("supplier-", "s_suppkey").alias("id"))


_CUR = """
    WITH p AS (SELECT 'part-' || p_partkey AS id FROM part WHERE p_size > 5 UNION ALL SELECT 'supplier-' || r_regionkey FROM region), s AS (SELECT 'supplier-' || s_suppkey AS id FROM supplier WHERE s_acctbal > 0),
    keys AS (SELECT 0 AS phase, 'products' AS c, 'productId' AS f, p_partkey AS ord, 'part-' || p_size AS id FROM part UNION ALL SELECT DISTINCT 1, 'compositions', 'solutionId', l_suppkey, 'supplier-' || l_suppkey FROM lineitem
        UNION ALL SELECT 2, 'pricing', 'productId', p_partkey, 'part-' || p_partkey FROM part WHERE p_retailprice > 915 UNION ALL SELECT 3, 'learningNotes', 'productId', o_orderkey, 'part-' || o_orderkey FROM orders
        UNION ALL SELECT 4, 'scenarios', 'id', n_nationkey, 'supplier-' || n_nationkey FROM nation UNION ALL SELECT 5, 'narration', 'productId', c_custkey, 'part-' || c_custkey FROM customer
        UNION ALL SELECT 6, 'solutionNotes', 'solutionId', s_suppkey, 'supplier-' || s_nationkey FROM supplier),
    b AS (SELECT s_suppkey AS ord, 'supplier-' || s_nationkey AS a, 0 AS k, 'supplier-' || s_nationkey AS o FROM supplier UNION ALL SELECT s_suppkey, 'supplier-' || s_nationkey, 1, 'supplier-' || s_suppkey FROM supplier),
    l AS (SELECT l_suppkey AS ord, 'part-' || l_partkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS k FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)),
    i AS (SELECT 'unknown-entity-reference' AS code, c || '[' || ord || '].' || f AS path, 'Unknown products id ''' || id || '''' AS message, phase, ord, -1 AS sub FROM keys WHERE f = 'productId' AND id NOT IN (SELECT id FROM p)
        UNION ALL SELECT 'unknown-entity-reference', c || '[' || ord || '].' || f, 'Unknown solutions id ''' || id || '''', phase, ord, -1 FROM keys WHERE f = 'solutionId' AND id NOT IN (SELECT id FROM s)
        UNION ALL SELECT 'unknown-entity-reference', 'compositions[' || ord || '].productIds[' || k || ']', 'Unknown products id ''' || id || '''', 1, ord, k FROM l WHERE id NOT IN (SELECT id FROM p)
        UNION ALL SELECT 'duplicate-id', 'scenarios[' || ord || '].id', 'Scenario id ''' || id || ''' collides with a solution id', 4, ord, -1 FROM keys WHERE c = 'scenarios' AND id IN (SELECT id FROM s)
        UNION ALL SELECT 'unknown-entity-reference', 'scenarios[' || n_nationkey || '].productIds[0]', 'Unknown products id ''part-' || n_nationkey || '''', 4, n_nationkey, 0 FROM nation WHERE 'part-' || n_nationkey NOT IN (SELECT id FROM p)
        UNION ALL SELECT 'unknown-entity-reference', 'scenarios[' || n_nationkey || '].productIds[1]', 'Unknown products id ''none-' || n_nationkey || '''', 4, n_nationkey, 1 FROM nation
        UNION ALL SELECT 'unknown-entity-reference', 'solutionNotes[' || ord || '].boundariesKo[' || k || '].solutionId', 'Unknown solutions id ''' || o || '''', 6, ord, 2 * k FROM b WHERE o NOT IN (SELECT id FROM s)
        UNION ALL SELECT 'duplicate-id', 'solutionNotes[' || ord || '].boundariesKo[' || k || '].solutionId', 'Solution ''' || a || ''' cannot bound itself', 6, ord, 2 * k + 1 FROM b WHERE o = a
        UNION ALL SELECT DISTINCT 'duplicate-id', 'catalog.solutions[' || id || ']', 'New id of a product and a solution ''' || id || '''', 7, 0, 0 FROM s WHERE id IN (SELECT id FROM p) AND id <> 'supplier-1')"""


@query(_CUR + " SELECT * FROM i")
def curated_reference_issues(s, d):
    return integrity.curated_reference_issues(_curated(s, d), *_known(s, d), ["supplier-1"])


@query(_CUR + """ SELECT 'duplicate-id' AS code, c || '[' || ord || '].' || f AS path, 'Duplicate ' || f || ' ''' || id || ''' in ' || c AS message, phase, ord, 0 AS sub
    FROM (SELECT *, row_number() OVER (PARTITION BY c, id ORDER BY ord) AS n FROM keys) WHERE n > 1""")
def curated_duplicate_ids(s, d):
    return integrity.curated_issues(_curated(s, d))


@query(_DOC + """, shape AS (SELECT 'invalid-shape' AS code, 'solutions[' || s_suppkey || '].id' AS path, 'slug' AS message, 0 AS phase, s_suppkey AS ord, NULL::BIGINT AS sub FROM supplier WHERE s_acctbal < 0)
    SELECT * FROM shape UNION ALL SELECT * FROM i WHERE NOT EXISTS (FROM shape)""")
def two_phase_issues(s, d):
    odd = t(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("ord"))
    shape = integrity.report([integrity.issues(odd, "invalid-shape", X.issue_path("solutions", F.col("ord"), "id"), F.lit("slug"), F.col("ord"))])
    return integrity.two_phases(shape, lambda: integrity.document_issues(_catalog(s, d)))


@query("""SELECT s_suppkey AS ord, 'supplier-' || s_suppkey AS "solutionId",
    CASE WHEN 'supplier-' || s_nationkey <= 'supplier-' || s_suppkey THEN s_name || ',' || s_name || '!' ELSE s_name || '!,' || s_name END AS notes FROM supplier""")
def normalized_solution_notes(s, d):
    bounds = F.array(F.struct(_id("supplier-", "s_nationkey").alias("solutionId"), F.col("s_name").alias("noteKo")), F.struct(_id("supplier-", "s_suppkey").alias("solutionId"), F.concat("s_name", F.lit("!")).alias("noteKo")))
    rows = t(s, d, "supplier").select(F.col("s_suppkey").alias("ord"), _id("supplier-", "s_suppkey").alias("solutionId"), bounds.alias("boundariesKo"))
    return curated_build.normalized("solutionNotes", rows).select("ord", "solutionId", F.array_join(F.transform("boundariesKo", lambda b: b["noteKo"]), ",").alias("notes"))


@query("""WITH p AS (SELECT l_suppkey, string_agg('part-' || l_partkey, ',' ORDER BY 'part-' || l_partkey) AS ids FROM lineitem GROUP BY 1)
    SELECT row_number() OVER (ORDER BY 'supplier-' || l_suppkey) - 1 AS ord, 'supplier-' || l_suppkey AS "solutionId", md5(ids) AS ids_md5 FROM p""")
def built_compositions(s, d):
    parts = t(s, d, "lineitem").groupBy("l_suppkey").agg(F.transform(F.collect_list("l_partkey"), lambda x: F.concat(F.lit("part-"), x.cast("string"))).alias("productIds"))
    built = curated_build.build({"compositions": parts.select(_id("supplier-", "l_suppkey").alias("solutionId"), "productIds")})
    return built["compositions"].select("ord", "solutionId", F.md5(F.array_join("productIds", ",")).alias("ids_md5"))


# claims and assembly --------------------------------------------------------------------------------------------------
def _made_pages(s, d) -> DataFrame:
    """A page per supplier (a solution with its use cases), per part (a product with one) and per brand and type of part
    (an overview of the products of one family), as HTML, with source, configured kind and URL."""
    head = lambda path, about: F.concat(F.lit("<html><head><title>A page</title><link rel=canonical href='"), path, F.lit("'><meta name=description content='"), about, F.lit("'></head><body>"))
    item = lambda root, k, name, about: F.concat(F.lit(f'<p data-cms-path="{root}{k}.title">'), name, F.lit(f'</p><p data-cms-path="{root}{k}.description">'), about, F.lit("</p>"))
    hero, eyebrow = page_parsers.PRODUCT_HERO, page_parsers.SOLUTION_EYEBROW
    used = lambda rule: f"{rule[0]}x{rule[1]}"
    page = lambda rows, source, kind, path, html: rows.select(source.alias("source"), F.lit(kind).alias("page_kind"), F.concat(F.lit(f"https://{SITE}"), path).alias("url"), html.alias("html"))
    part, sup = t(s, d, "part"), t(s, d, "supplier")
    path = _id("/products/part-", "p_partkey")
    size = F.concat(F.lit("Size "), F.col("p_size").cast("string"))
    products = page(part, _id("product-", "p_partkey"), "marketing-product", path, F.concat(head(path, F.col("p_name")), F.lit(f'<h1 data-cms-path="{hero[0]}{hero[1]}">x</h1>'), item(used(page_parsers.PRODUCT_USE_CASES), 1, size, size)))
    spath = _id("/solutions/s-", "s_suppkey")
    nation = F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"))
    solutions = page(sup, _id("solution-", "s_suppkey"), "marketing-solution", spath, F.concat(head(spath, F.col("s_name")), F.lit(f'<p data-cms-path="{eyebrow[0]}{eyebrow[1]}">'), F.col("s_name"), F.lit("</p>"), item(used(page_parsers.SOLUTION_USE_CASES), 1, nation, nation)))
    card = F.concat(F.lit('<a href="'), path, F.lit('"><div><strong>'), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")), F.lit("</strong></div>"), F.when(F.col("p_size") > 25, F.concat(F.lit("<p>"), F.col("p_type"), F.lit("</p>"))).otherwise(""), F.lit("</a>"))
    shelf = part.select("p_brand", F.floor(F.col("p_partkey") / 50).alias("shelf"), "p_partkey", card.alias("card"))  # at most fifty cards a page
    figures = shelf.groupBy("p_brand", "shelf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "card"))), lambda x: x["card"]), "").alias("cards"))
    opath = F.concat(F.lit("/overview/"), F.substring("p_brand", 7, 9), F.lit("-"), F.col("shelf").cast("string"))
    overviews = page(figures, F.concat(F.lit("overview-"), F.substring("p_brand", 7, 9), F.lit("-"), F.col("shelf").cast("string")), "marketing-overview", opath, F.concat(head(opath, F.lit("All")), F.lit("<figure><figcaption>"), F.col("p_brand"), F.lit("</figcaption>"), F.col("cards"), F.lit("</figure>")))
    return products.unionByName(solutions).unionByName(overviews)


def _claims(s, d) -> claims.Claims:
    made = _made_pages(s, d)
    parsed = page_parsers.parse(made, key="source", configured="page_kind", partitions=s.sparkContext.defaultParallelism)
    parsed = parsed.join(made.select("source", "page_kind"), "source").withColumn("retrieved_at", F.lit("2024-01-01T00:00:00Z"))
    return claims.normalized(parsed, DOCS)


@query("""SELECT 'products' AS collection, 'part-' || p_partkey AS id, 'Part ' || p_partkey AS name, p_name AS summary, lower(replace(p_brand, '#', '-')) AS family, 'overview-' || substr(p_brand, 7) || '-' || p_partkey // 50 || ',product-' || p_partkey AS sources FROM part
    UNION ALL SELECT 'solutions', 's-' || s_suppkey, s_name, s_name, NULL, 'solution-' || s_suppkey FROM supplier
    UNION ALL SELECT 'productFamilies', lower(replace(p_brand, '#', '-')), p_brand, 'Product family "' || p_brand || '" as grouped on the official products overview.', NULL, string_agg(DISTINCT 'overview-' || substr(p_brand, 7) || '-' || p_partkey // 50, ',' ORDER BY 'overview-' || substr(p_brand, 7) || '-' || p_partkey // 50) FROM part GROUP BY p_brand
    UNION ALL SELECT 'useCases', 'size-' || p_size, 'Size ' || p_size, 'Size ' || p_size, NULL, string_agg('product-' || p_partkey, ',' ORDER BY 'product-' || p_partkey) FROM part GROUP BY p_size
    UNION ALL SELECT 'useCases', 'nation-' || s_nationkey, 'Nation ' || s_nationkey, 'Nation ' || s_nationkey, NULL, string_agg('solution-' || s_suppkey, ',' ORDER BY 'solution-' || s_suppkey) FROM supplier GROUP BY s_nationkey
    UNION ALL SELECT 'relationships', 'product-use-case', 'part-' || p_partkey, 'size-' || p_size, NULL, 'product-' || p_partkey FROM part
    UNION ALL SELECT 'relationships', 'solution-use-case', 's-' || s_suppkey, 'nation-' || s_nationkey, NULL, 'solution-' || s_suppkey FROM supplier""")
def catalog_from_pages(s, d):
    catalog, _ = assemble.assembled(_claims(s, d))
    null = F.lit(None).cast("string")
    joined = F.array_join("sourceIds", ",").alias("sources")
    rows = lambda c, *cols: catalog[c].select(F.lit(c).alias("collection"), *cols, joined)
    out = rows("products", "id", "name", "summary", F.col("familyId").alias("family"))
    for c in ("solutions", "productFamilies", "useCases"):
        out = out.unionByName(rows(c, "id", "name", "summary", null.alias("family")))
    return out.unionByName(rows("relationships", F.col("type").alias("id"), F.col("fromId").alias("name"), F.col("toId").alias("summary"), null.alias("family")))


def _order_claims(s, d) -> DataFrame:
    """Orders as product claims: the customer is the product, the priority weighs, status and month are what is stated."""
    o = t(s, d, "orders")
    return o.select(
        _id("o-", "o_orderkey").alias("source"), _id("o-", "o_orderkey").alias("url"), F.substring("o_orderpriority", 1, 1).cast("int").alias("precedence"), _id("/c/", "o_custkey").alias("key"), F.concat(F.lit("c"), (F.col("o_custkey") - F.col("o_custkey") % 2).cast("string")).alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("name"), F.when(F.col("o_totalprice") > 250000, "dear").alias("summary"), F.when(F.month("o_orderdate") > 6, "late").otherwise("early").alias("family_id"),
    )


_CLAIMS = """WITH o AS (SELECT 'o-' || o_orderkey AS source, substr(o_orderpriority, 1, 1)::INT AS p, '/c/' || o_custkey AS key, 'c' || o_custkey - o_custkey % 2 AS id, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS name,
        CASE WHEN o_totalprice > 250000 THEN 'dear' END AS summary, CASE WHEN month(o_orderdate) > 6 THEN 'late' ELSE 'early' END AS family_id FROM orders),
    f AS (SELECT key, 'name' AS field, p, name AS v, source FROM o WHERE name IS NOT NULL UNION ALL SELECT key, 'summary', p, summary, source FROM o WHERE summary IS NOT NULL UNION ALL SELECT key, 'family_id', p, family_id, source FROM o),
    top AS (SELECT *, max(p) OVER (PARTITION BY key, field) AS m FROM f), v AS (SELECT key, field, min(v) AS v, count(DISTINCT v) AS n, string_agg(DISTINCT source, ' and ' ORDER BY source) AS urls FROM top WHERE p = m GROUP BY ALL),
    g AS (SELECT key, min(id) AS id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, arg_min(source, (-p, source)) AS best FROM o GROUP BY 1),
    e AS (SELECT g.*, a.v AS name, b.v AS summary, c.v AS family_id FROM g LEFT JOIN v a ON a.key = g.key AND a.field = 'name' LEFT JOIN v b ON b.key = g.key AND b.field = 'summary' LEFT JOIN v c ON c.key = g.key AND c.field = 'family_id')"""


@query(_CLAIMS + " SELECT id, name, summary, family_id, sources FROM e WHERE name IS NOT NULL AND family_id IS NOT NULL")
def assembled_entities(s, d):
    rows, _ = assemble.entities(_order_claims(s, d), "key", ["name", "summary", "family_id"], "product", optional=("summary",))
    return rows.select("id", "name", "summary", "family_id", F.array_join("sourceIds", ",").alias("sources"))


@query(_CLAIMS + """ SELECT 'normalize' AS stage, 'product ' || key AS subject, 'conflicting ' || field || ' between ' || urls AS message FROM v WHERE n > 1
    UNION ALL SELECT 'normalize', 'product ' || id, 'incomplete: ' || best FROM e WHERE name IS NULL OR family_id IS NULL
    UNION ALL SELECT 'normalize', 'product ' || id, 'id of two keys: ' || min(key) || ' and ' || max(key) FROM g GROUP BY id HAVING count(*) > 1""")
def assembly_problems(s, d):
    return assemble.entities(_order_claims(s, d), "key", ["name", "summary", "family_id"], "product", optional=("summary",))[1]


@query("""WITH x AS (SELECT DISTINCT 'product-solution' AS type, 'part-' || l_partkey AS a, 'supplier-' || l_suppkey AS b FROM lineitem)
    SELECT 'normalize' AS stage, type || ' ' || a || ' ' || b AS subject, 'unknown products id ' || a AS message FROM x WHERE a NOT IN (SELECT 'part-' || p_partkey FROM part WHERE p_size > 5)
    UNION ALL SELECT 'normalize', type || ' ' || a || ' ' || b, 'unknown solutions id ' || b FROM x WHERE b NOT IN (SELECT 'supplier-' || s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def dangling_edges(s, d):
    products, solutions = _known(s, d)
    edges = t(s, d, "lineitem").select(_id("s-", "l_linenumber").alias("source"), F.lit("product-solution").alias("type"), _id("part-", "l_partkey").alias("from_id"), _id("supplier-", "l_suppkey").alias("to_id"))
    return assemble.relationships(edges, {"products": products.where("startswith(id, 'part')"), "solutions": solutions, "useCases": solutions.limit(0)})[1]


@query("""WITH x AS (SELECT l_partkey, l_suppkey, string_agg(DISTINCT 's-' || l_linenumber, ',' ORDER BY 's-' || l_linenumber) AS s FROM lineitem GROUP BY ALL) SELECT 'part-' || l_partkey AS a, 'supplier-' || l_suppkey AS b, s AS sources FROM x""")
def assembled_edges(s, d):
    edges = t(s, d, "lineitem").select(_id("s-", "l_linenumber").alias("source"), F.lit("product-solution").alias("type"), _id("part-", "l_partkey").alias("from_id"), _id("supplier-", "l_suppkey").alias("to_id"))
    none = edges.select(F.col("source").alias("id"))
    return assemble.relationships(edges, {"products": none, "solutions": none, "useCases": none})[0].select(F.col("fromId").alias("a"), F.col("toId").alias("b"), F.array_join("sourceIds", ",").alias("sources"))


@query("""WITH d AS (SELECT p_partkey AS k, ['n-' || p_size] AS own, list_sort(list_distinct(list_append(coalesce(m, []), 'n-' || p_size))) AS s FROM part
        LEFT JOIN (SELECT l_partkey, list(DISTINCT 'l-' || l_linenumber) AS m FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_partkey = p_partkey) SELECT 'part-' || k AS id, array_to_string(s, ',') AS sources FROM d""")
def docs_enriched_products(s, d):
    products = t(s, d, "part").select(_id("part-", "p_partkey").alias("id"), F.array(_id("n-", "p_size")).alias("sourceIds"))
    docs = t(s, d, "lineitem").select(F.when(F.col("l_quantity") > 40, _id("part-", "l_partkey")).alias("slug"), _id("l-", "l_linenumber").alias("source"))
    return assemble.enriched(products, docs).select("id", F.array_join("sourceIds", ",").alias("sources"))
