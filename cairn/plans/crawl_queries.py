"""Registered queries of whole runs, on the tables at hand, each with its SQL.

Roles: sources = supplier (a solution's page each) and pages (documentation that fits no kind); answers are made from both: errors,
redirects and odd pages by the supplier's nation, a disallowed path by its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import assemble, crawl
from cairn.operators.claims import Claims
from cairn.plans.document_queries import DOCS, SITE, _id
from cairn.plans.registry import query, t
from cairn.sources import page_parsers

ROBOTS = "user-agent: *\ndisallow: /solutions/s-*7$\ncrawl-delay: 1"


def _run(s, d) -> crawl.Run:
    sup, docs = t(s, d, "supplier"), t(s, d, "pages")
    n, key = F.col("s_nationkey") % 8, F.col("s_suppkey").cast("string")
    path, name = F.concat(F.lit("/solutions/s-"), key), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"))
    eyebrow, used = "x".join(page_parsers.SOLUTION_EYEBROW), "x".join(page_parsers.SOLUTION_USE_CASES)
    html = F.concat(
        F.lit("<html><head><title>A page</title><link rel=canonical href='"), path, F.lit("'><meta name=description content='"), F.col("s_name"), F.lit(f'\'></head><body><p data-cms-path="{eyebrow}">'), F.col("s_name"),
        F.lit(f'</p><p data-cms-path="{used}1.title">'), F.when(n == 5, "!").otherwise(name), F.lit(f'</p><p data-cms-path="{used}1.description">'), name, F.lit("</p>"),
    )
    url, moved = F.concat(F.lit(f"https://{SITE}"), path), F.concat(F.lit("/moved/s-"), key)
    durl = F.concat(F.lit(f"https://{DOCS}/page/"), F.col("page_id").cast("string"))
    sources = sup.select(F.col("s_suppkey").alias("ord"), _id("solution-", "s_suppkey").alias("id"), url.alias("url"), F.lit("marketing-solution").alias("page_kind"))
    sources = sources.unionByName(docs.select((F.col("page_id") + 1_000_000_000).alias("ord"), _id("page-", "page_id").alias("id"), durl.alias("url"), F.lit("developer-docs").alias("page_kind")))
    answer = lambda rows, u, status, location, body: rows.select(u.alias("url"), status.cast("int").alias("status"), location.cast("string").alias("location"), body.alias("html"), F.lit("2024-01-01T00:00:00.000Z").alias("retrieved_at"))
    none = F.lit(None)
    goes = F.when(n == 2, F.concat(F.lit("https://elsewhere.example/"), key)).when(n == 3, moved)
    answers = answer(sup, url, F.when(n == 0, 500).when(n.isin(2, 3), 301).otherwise(200), goes, F.when(n == 4, "<html></html>").otherwise(html))
    answers = answers.unionByName(answer(sup.where(n == 3), F.concat(F.lit(f"https://{SITE}"), moved), F.lit(200), none, html)).unionByName(answer(docs, durl, F.when(F.col("page_id") % 5 == 0, 404).otherwise(200), none, F.col("html")))
    hosts = s.createDataFrame([(SITE, 200, ROBOTS), (DOCS, 404, None)], "host string, status int, body string")
    return crawl.run(sources, hosts, answers, "bot", [SITE, DOCS], 1000, DOCS, partitions=s.sparkContext.defaultParallelism)


_RUN = f"""WITH u AS (SELECT s_suppkey AS ord, s_nationkey % 8 AS n, 'https://{SITE}/solutions/s-' || s_suppkey AS url, s_suppkey AS k, s_nationkey AS nation FROM supplier),
    f AS (SELECT *, CASE WHEN k % 10 = 7 THEN 'robots' WHEN n IN (0, 2) THEN 'fetch' WHEN n IN (3, 4) THEN 'parse' WHEN n = 5 THEN 'normalize' END AS stage FROM u),
    d AS (SELECT page_id + 1000000000 AS ord, 'https://{DOCS}/page/' || page_id AS url, page_id % 5 = 0 AS lost FROM pages)"""


@query(_RUN + f""" SELECT CASE WHEN stage <> 'normalize' THEN ord END AS ord, stage, CASE WHEN stage = 'fetch' AND n = 2 THEN 'https://elsewhere.example/' || k WHEN stage = 'parse' AND n = 3 THEN 'https://{SITE}/moved/s-' || k ELSE url END AS subject,
        CASE stage WHEN 'robots' THEN 'path disallowed' WHEN 'fetch' THEN CASE n WHEN 0 THEN 'HTTP 500' ELSE 'URL is not allowed' END WHEN 'parse' THEN CASE n WHEN 3 THEN 'canonical link of another page' ELSE 'none of the kinds fit' END ELSE 'no id from the name of card !' END AS message
    FROM f WHERE stage IS NOT NULL UNION ALL SELECT ord, CASE WHEN lost THEN 'fetch' ELSE 'parse' END, url, CASE WHEN lost THEN 'HTTP 404' ELSE 'none of the kinds fit' END FROM d""")
def crawl_failures(s, d) -> DataFrame:
    return _run(s, d).failures


@query(_RUN + """, ok AS (SELECT * FROM f WHERE stage IS NULL OR stage = 'normalize')
    SELECT 'configured' AS name, (SELECT count(*) FROM u) + (SELECT count(*) FROM d) AS n UNION ALL SELECT 'fetched', (SELECT count(*) FROM f WHERE stage IS NULL OR stage NOT IN ('robots', 'fetch')) + (SELECT count(*) FROM d WHERE NOT lost)
    UNION ALL SELECT 'parsed', (SELECT count(*) FROM ok) UNION ALL SELECT 'sources', (SELECT count(*) FROM ok) UNION ALL SELECT 'products', 0 UNION ALL SELECT 'productFamilies', 0 UNION ALL SELECT 'solutions', (SELECT count(*) FROM ok) UNION ALL SELECT 'useCases', (SELECT count(DISTINCT nation) FROM ok WHERE n <> 5) UNION ALL SELECT 'relationships', (SELECT count(*) FROM ok WHERE n <> 5)""")
def crawl_counts(s, d) -> DataFrame:
    return s.createDataFrame(sorted(_run(s, d).counts.items()), "name string, n long")


# a page a part, whose summaries changed where parts have size 7, and a page a supplier
def _stated(s, d, changed: bool) -> Claims:
    part, sup = t(s, d, "part"), t(s, d, "supplier")
    text = lambda x: (F.lit(x) if x is None else x).cast("string")
    source = lambda rows, key, url, kind, weight: rows.select(_id(f"{kind}-", key).alias("id"), _id(url, key).alias("url"), F.lit(kind).alias("page_kind"), F.lit("t").alias("title"), F.lit("r").alias("retrieved_at"), F.lit(weight).alias("precedence"))
    summary = F.when((F.col("p_size") == 7) & F.lit(changed), F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type"))
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    of = F.col("source")
    part, sup = part.withColumn("source", _id("product-", "p_partkey")), sup.withColumn("source", _id("solution-", "s_suppkey"))
    none = part.where("false")
    size = F.concat(F.lit("size-"), F.col("p_size").cast("string"))
    return Claims(
        source(part, "p_partkey", "/p/", "product", 1).unionByName(source(sup, "s_suppkey", "/s/", "solution", 1)), part.select(of, brand.alias("id"), F.col("p_brand").alias("name")),
        part.select(of, _id("/p/", "p_partkey").alias("key"), _id("part-", "p_partkey").alias("id"), F.col("p_name").alias("name"), summary.alias("summary"), brand.alias("family_id")),
        sup.select(of, _id("/s/", "s_suppkey").alias("key"), _id("s-", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_name").alias("summary")),
        part.select(of, size.alias("id"), size.alias("name"), size.alias("summary")), part.select(of, F.lit("product-use-case").alias("type"), _id("part-", "p_partkey").alias("from_id"), size.alias("to_id")),
        none.select(of, text(None).alias("slug")), none.select(of, text(None).alias("url"), text(None).alias("message")),
    )


def _refreshed(s, d):
    before = _stated(s, d, False)
    return assemble.refreshed(before, assemble.assembled(before)[0], _stated(s, d, True))


@query("SELECT 'part-' || p_partkey AS id, p_name AS name, CASE WHEN p_size = 7 THEN p_type || '!' ELSE p_type END AS summary, lower(replace(p_brand, '#', '-')) AS family, 'product-' || p_partkey AS sources FROM part")
def refreshed_products(s, d) -> DataFrame:
    return _refreshed(s, d)[0]["products"].select("id", "name", "summary", F.col("familyId").alias("family"), F.array_join("sourceIds", ",").alias("sources"))


@query("SELECT 'products' AS collection, '/p/' || p_partkey AS key FROM part WHERE p_size = 7 UNION ALL SELECT 'relationships', 'product-use-case part-' || p_partkey || ' size-7' FROM part WHERE p_size = 7")
def refreshed_keys(s, d) -> DataFrame:
    """What was assembled anew: the parts of size 7 and the edges that lead from them."""
    touched = _refreshed(s, d)[2]
    parts = [rows.select(F.lit(c).alias("collection"), F.concat_ws(" ", *rows.columns).alias("key")) for c, rows in touched.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
