"""Registered queries: the catalog operators on the tables at hand, each with its SQL.

Roles: product = part, family = p_brand, solution = supplier, composition = (l_suppkey, l_partkey), lane and layer =
(l_returnflag, l_linestatus), page = pages, claim = orders of a customer, learner = events.user_id, area = event_type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import curated, integrity, merge, pricing, progress, readmodels, recall, robots, scenario
from cairn.plans.registry import query, t
from cairn.sources import page_parsers
from cairn.sources import pages as P

LAYERS = [("A", "F", 1), ("A", "O", 2), ("N", "F", 3), ("N", "O", 4), ("R", "F", 5), ("R", "O", 6)]
HOSTS = ["therat.example.net", "ththed.example.org", "tionsh.example.net"]
ROBOTS = [
    ("therat.example.net", "User-agent: *\nDisallow: /de/\nAllow: /de/1\nCrawl-delay: 2\n"),
    ("ththed.example.org", "User-agent: cairn\nUser-agent: other\nDisallow: /*5$\nDisallow: /fr/\nAllow: /fr/\n\nUser-agent: *\nDisallow: /"),
    ("h4.example.net", "User-agent: a\nUser-agent:\nDisallow: /a\nCrawl-delay: x\nUser-agent: cairn\nCrawl-delay: 2\nCrawl-delay: 7\nDisallow: /b"),
    ("tionsh.example.net", "# all\r\nUser-agent: *\r\nDisallow:\r\nUser-agent: x\r\nDisallow: /"),
]
TODAY = "2024-01-31"


def _products(s, d):
    return t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def _placements(s, d):
    return t(s, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("lane"), F.col("l_linestatus").alias("layer"))


def _members(s, d):
    return t(s, d, "lineitem").select(F.col("l_suppkey").alias("solution"), F.col("l_partkey").alias("id"))


def _layers(s):
    return s.createDataFrame(LAYERS, "lane string, layer string, ord int")


_L = "(VALUES " + ", ".join(map(str, LAYERS)) + ") AS layers(lane, layer, ord)"
_PL = "SELECT l_partkey AS id, l_returnflag AS lane, l_linestatus AS layer FROM lineitem"


# integrity ------------------------------------------------------------------------------------------------------------
@query("SELECT o_custkey, o_orderkey, n AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1")
def dup_keys(s, d):
    return integrity.duplicate_keys(t(s, d, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", F.col("occurrence").cast("long").alias("occurrence"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (FROM customer c WHERE c.c_custkey = o.o_custkey AND c_acctbal > 0)")
def fk_missing_parent(s, d):
    return integrity.missing_references(t(s, d, "orders"), t(s, d, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def edge_duplicates(s, d):
    return t(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def edge_endpoint_missing(s, d):
    return integrity.missing_references(t(s, d, "lineitem"), t(s, d, "part").where("p_size <= 25"), "l_partkey", "p_partkey").select("l_suppkey", "l_partkey").distinct()


@query("SELECT DISTINCT p_partkey AS id FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)")
def id_collisions_across_collections(s, d):
    return integrity.collisions(t(s, d, "part"), t(s, d, "supplier"), "p_partkey", "s_suppkey")


def _issues(s, d):
    products = t(s, d, "part").select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("family"), F.col("p_partkey").alias("ord"))
    families = t(s, d, "part").where("p_size > 3 AND p_brand < 'Brand#4'").select(F.col("p_brand").alias("family")).distinct().withColumnRenamed("family", "family_id")
    edges = t(s, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return integrity.catalog_issues(products, families, edges, "product", "family", "family_id", "a", "b")


_ISSUES = """
    WITH f AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 3 AND p_brand < 'Brand#4'),
    e AS (SELECT l_suppkey AS a, l_partkey AS b, l_orderkey * 10 + l_linenumber AS ord, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem),
    i AS (SELECT 'unknown-entity-reference' AS code, 'products[' || p_partkey || '].familyId' AS path, p_brand AS message, p_partkey AS ord, 1 AS phase FROM part WHERE p_brand NOT IN (FROM f)
          UNION ALL SELECT 'duplicate-relationship', 'relationships[' || ord || ']', a || ' ' || b, ord, 2 FROM e WHERE n > 1)"""


@query(_ISSUES + " SELECT code, count(*) AS n, min(path) AS first_path FROM i GROUP BY code")
def issue_summary(s, d):
    return integrity.summary(_issues(s, d))


@query(_ISSUES + " SELECT *, greatest((SELECT count(*) FROM i) - 10, 0) AS hidden FROM i ORDER BY phase, ord, path LIMIT 10")
def issue_top10_hidden(s, d):
    return integrity.visible(_issues(s, d))


# scalars --------------------------------------------------------------------------------------------------------------
_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_C = f"trim(regexp_replace(text, '{_WS}', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_C}) AS collapsed_md5, length({_C}) AS n FROM documents")
def collapse_ws(s, d):
    c = X.collapse_whitespace(F.col("text"))
    return t(s, d, "documents").select("doc_id", F.md5(c).alias("collapsed_md5"), F.length(c).cast("long").alias("n"))


@query(f"SELECT doc_id, CASE WHEN length({_C}) BETWEEN 1 AND 200 THEN {_C} END AS title FROM documents")
def bounded_title(s, d):
    return t(s, d, "documents").select("doc_id", X.bounded_field(F.col("text"), X.TITLE_CAP).alias("title"))


@query(f"""WITH c AS (SELECT doc_id, {_C} AS c FROM documents), w AS (SELECT *, substring(c, 1, 500) AS w, regexp_extract(substring(c, 1, 500), '^(.+[.!?]) ', 1, 's') AS b FROM c)
    SELECT doc_id, CASE WHEN length(c) <= 500 THEN c WHEN b <> '' THEN b WHEN w[-1] IN ('.', '!', '?') THEN w ELSE rtrim(w) END AS summary FROM w""")
def trim_summary_500(s, d):
    return t(s, d, "documents").select("doc_id", X.trim_summary(F.col("text")).alias("summary"))


@query("SELECT p_partkey, nullif(regexp_replace(substring(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), '-+$', ''), '') AS slug FROM part")
def slug_ascii(s, d):
    return t(s, d, "part").select("p_partkey", X.slugify_ascii(F.col("p_name")).alias("slug"))


_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_SEG = f"list_filter(string_split({_PATH}, '/'), lambda x: x <> '')"
_LAST = f"nullif(regexp_replace(substring(regexp_replace(regexp_replace(lower(({_SEG})[-1]), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), '-+$', ''), '')"


@query(f"SELECT page_id, CASE WHEN lower({_PATH}) IN ('', '/') THEN '/' ELSE regexp_replace(lower({_PATH}), '/$', '') END AS path_key, {_LAST} AS last_id FROM pages")
def path_key(s, d):
    return t(s, d, "pages").select("page_id", X.path_key(F.col("url")).alias("path_key"), X.id_from_path(F.col("url")).alias("last_id"))


@query(f"SELECT page_id, coalesce(regexp_matches(url, '^https://[^/?#@:]+(/[^?#]*)?$') AND {_HOST} IN {tuple(HOSTS)} AND length(url) <= 300, false) AS canonical, CASE WHEN {_HOST} = '{HOSTS[0]}' AND len({_SEG}) = 1 THEN {_LAST} END AS docs_slug FROM pages")
def url_canonical_check(s, d):
    return t(s, d, "pages").select("page_id", X.canonical_url(F.col("url"), HOSTS).alias("canonical"), X.docs_slug(F.col("url"), HOSTS[0]).alias("docs_slug"))


# pages ----------------------------------------------------------------------------------------------------------------
_TITLE = f"trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '{_WS}', ' ', 'g'))"


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(s, d):
    return t(s, d, "pages").select("page_id", P.title(F.col("html")).alias("title"))


@query("SELECT page_id, 'missing ' || m AS message FROM pages, (VALUES ('link[rel=\"canonical\"]', '<link[^>]*rel=\"canonical\"'), ('meta[name=\"description\"]', '<meta[^>]*name=\"description\"'), ('title', '<title')) v(m, r) WHERE NOT regexp_matches(html, r)")
def page_required_meta_issues(s, d):
    wanted = {'link[rel="canonical"]': '<link[^>]*rel="canonical"', 'meta[name="description"]': '<meta[^>]*name="description"', "title": "<title"}
    checks = F.array_compact(F.array(*(F.when(~F.col("html").rlike(r), F.lit("missing " + m)) for m, r in wanted.items())))
    return t(s, d, "pages").select("page_id", F.explode(checks).alias("message"))


_KINDS = {"table-like": r"(?s)<p>[^<]* \| ", "licensed": r"Licensed under", "plain": r"(?s)<article><h1>[A-Z][a-z]"}


@query("WITH k AS (SELECT page_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '{r}') THEN '{k}' END" for k, r in _KINDS.items()) + "], lambda x: x IS NOT NULL) AS k FROM pages) SELECT page_id, CASE len(k) WHEN 1 THEN k[1] WHEN 0 THEN 'none' ELSE 'several' END AS kind FROM k")
def page_kind_detect(s, d):
    return t(s, d, "pages").select("page_id", P.page_kind(F.col("html"), _KINDS).alias("kind"))


@query(f"SELECT {_HOST} AS host, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def host_counts(s, d):
    return t(s, d, "pages").groupBy(X.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("SELECT page_id, count(*) AS n_links, max(href) AS last_href FROM (SELECT page_id, regexp_extract(a, 'href=\"([^\"]*)\"', 1) AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">[^<]*</a>', 0, 's')) AS a FROM pages)) GROUP BY page_id")
def page_nav_links(s, d):
    return P.nav_entries(t(s, d, "pages"), "page_id", "html").groupBy("page_id").agg(F.count("*").alias("n_links"), F.max("href").alias("last_href"))


@query("WITH g AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS \"user\", arg_max(text, turn) FILTER (role = 'assistant') AS assistant FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1) SELECT conv_id, \"user\", assistant, \"user\" IS NOT NULL AND assistant IS NOT NULL AS complete FROM g")
def usecase_pivot(s, d):
    return P.card_pivot(t(s, d, "conversations").dropDuplicates(["conv_id", "turn"]), "conv_id", "role", "text", ["user", "assistant"], "turn")


# merge ----------------------------------------------------------------------------------------------------------------
def _claims(s, d):
    rank = F.when(F.col("o_orderpriority").startswith("1"), 2).when(F.col("o_orderpriority").startswith("2"), 2).when(F.col("o_orderpriority").startswith("3"), 1).otherwise(0)
    return t(s, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", rank.alias("precedence"))


_CLAIMS = "WITH c AS (SELECT o_custkey, o_orderstatus, o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 2 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END AS p FROM orders), r AS (SELECT *, max(p) OVER (PARTITION BY o_custkey) AS top FROM c), k AS (SELECT o_custkey, min(o_orderstatus) AS o_orderstatus, count(DISTINCT o_orderstatus) AS n_values FROM r WHERE p = top GROUP BY 1) "


@query(_CLAIMS + "SELECT * FROM k")
def claims_precedence_pick(s, d):
    return merge.pick(_claims(s, d), "o_custkey", "o_orderstatus", "precedence")


@query(_CLAIMS + "SELECT * FROM k WHERE n_values > 1")
def claims_conflicts(s, d):
    return merge.conflicts(_claims(s, d), "o_custkey", "o_orderstatus", "precedence")


@query(_CLAIMS + "SELECT o_custkey, arg_min(o_orderkey, (-p, o_orderkey)) AS o_orderkey FROM c GROUP BY 1")
def claims_best_source(s, d):
    return merge.best_url(_claims(s, d), "o_custkey", "o_orderkey", "precedence")


@query("SELECT l_suppkey, l_partkey, string_agg(DISTINCT l_shipmode, ',' ORDER BY l_shipmode) AS sources FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) GROUP BY ALL")
def edge_dedupe_union(s, d):
    return merge.source_union(t(s, d, "lineitem"), ["l_suppkey", "l_partkey"], "l_returnflag")


@query("SELECT p_brand, count(DISTINCT p_type) AS n_values, min(p_type) AS least, max(p_type) AS most FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def ambiguous_ids(s, d):
    return merge.ambiguous(t(s, d, "part"), "p_brand", "p_type")


@query("SELECT l_suppkey, string_agg(DISTINCT l_partkey, ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1")
def normalize_nested_sorted(s, d):
    return merge.nested_sorted(t(s, d, "lineitem"), "l_suppkey", F.col("l_partkey"), "parts").select("l_suppkey", F.array_join("parts", ",").alias("parts"))


@query("(SELECT n_nationkey, n_name, 'left' AS side FROM nation WHERE n_nationkey < 5) UNION ALL (SELECT n_nationkey, n_name, 'right' FROM nation WHERE n_nationkey > 20)")
def freshness_diff(s, d):
    n = t(s, d, "nation").select("n_nationkey", "n_name")
    return merge.difference(n.where("n_nationkey <= 20"), n.where("n_nationkey >= 5"))


# robots ---------------------------------------------------------------------------------------------------------------
def _robots(s):
    return robots.parse(s.createDataFrame(ROBOTS, "host string, body string"))


_ROBOTS = (
    "WITH f(host, body) AS (VALUES " + ", ".join(f"('{host}', '{body}')" for host, body in ROBOTS) + r"""),
    l AS (SELECT host, unnest(range(len(x))) AS pos, regexp_replace(unnest(x), '#.*', '') AS line FROM (SELECT host, regexp_split_to_array(body, '\r\n|\n|\r') AS x FROM f)),
    k AS (SELECT host, pos, lower(trim(split_part(line, ':', 1))) AS field, trim(regexp_replace(line, '^[^:]*:', '')) AS value FROM l WHERE contains(line, ':')),
    e AS (SELECT *, lag(field) OVER (PARTITION BY host ORDER BY pos) AS prev FROM k WHERE field IN ('allow', 'disallow') OR (field = 'user-agent' AND value <> '') OR (field = 'crawl-delay' AND try_cast(value AS DOUBLE) >= 0)),
    g AS (SELECT *, sum(CASE WHEN field = 'user-agent' AND prev IS DISTINCT FROM 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY pos) AS grp FROM e),
    b AS (SELECT host, coalesce(arg_max(lower(value), (length(value), -pos)) FILTER (value <> '*' AND contains('cairn', lower(value))), '*') AS token FROM g WHERE field = 'user-agent' GROUP BY 1),
    o AS (SELECT DISTINCT g.host, grp FROM g JOIN b ON b.host = g.host AND lower(value) = token AND field = 'user-agent'),
    r AS (SELECT g.host, value AS pattern, field = 'allow' AS allow, '^' || regexp_replace(replace(regexp_replace(value, '([\\.^$|?+()\[\]{}])', '\\\1', 'g'), '*', '.*'), '\\\$$', '$') AS re FROM g JOIN o ON o.host = g.host AND o.grp = g.grp WHERE field IN ('allow', 'disallow') AND value <> '')"""
)


# a robots file per supplier: two groups, the first for one agent or for all by its nation
_SUPPLIED = _ROBOTS.replace(_ROBOTS[_ROBOTS.index("(VALUES"):_ROBOTS.index("),\n    l AS")], """(SELECT 'h' || s_suppkey, 'User-agent: ' || CASE WHEN s_nationkey < 12 THEN 'cairn' ELSE '*' END || chr(10) || 'User-agent: other' || chr(10) || 'Crawl-delay: ' || s_nationkey || chr(10) || 'Disallow: /' || s_suppkey
        || CASE WHEN s_nationkey % 3 = 0 THEN chr(10) || 'user-agent: *' || chr(10) || 'crawl-delay: 0.5' || chr(10) || 'allow: /' ELSE '' END FROM supplier""")


def _supplied(s, d):
    n, lf = F.col("s_nationkey").cast("string"), F.lit("\n")
    more = F.when(F.col("s_nationkey") % 3 == 0, "\nuser-agent: *\ncrawl-delay: 0.5\nallow: /").otherwise("")
    body = F.concat(F.lit("User-agent: "), F.when(F.col("s_nationkey") < 12, "cairn").otherwise("*"), lf, F.lit("User-agent: other"), lf, F.lit("Crawl-delay: "), n, lf, F.lit("Disallow: /"), F.col("s_suppkey").cast("string"), more)
    return robots.parse(t(s, d, "supplier").select(F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("host"), body.alias("body")))


@query(_SUPPLIED + " SELECT host, grp::INT AS grp, count(*)::INT AS n FROM g WHERE grp > 0 GROUP BY ALL")
def robots_parse_groups(s, d):
    return _supplied(s, d).groupBy("host", F.col("group").cast("int").alias("grp")).agg(F.count("*").cast("int").alias("n"))


@query(_ROBOTS + f""", p AS (SELECT page_id, {_HOST} AS host, CASE WHEN starts_with({_PATH}, '/') THEN {_PATH} ELSE '/' || {_PATH} END AS path FROM pages),
    d AS (SELECT page_id, arg_max(allow, (length(pattern), allow)) AS allow FROM p JOIN r ON r.host = p.host AND regexp_matches(path, re) GROUP BY 1) SELECT page_id, coalesce(allow, true) AS allowed FROM p LEFT JOIN d USING (page_id)""")
def robots_allowed(s, d):
    paths = t(s, d, "pages").select("page_id", X.url_host(F.col("url")).alias("host"), X.url_path(F.col("url")).alias("path"))
    return robots.decisions(paths, _robots(s), "cairn").select("page_id", "allowed")


@query(_SUPPLIED + ", dl AS (SELECT g.host, g.grp, arg_max(value::DOUBLE, pos) AS delay FROM g JOIN o ON o.host = g.host AND o.grp = g.grp WHERE field = 'crawl-delay' GROUP BY ALL) SELECT host, arg_min(delay, grp) AS delay FROM dl GROUP BY 1")
def robots_crawl_delay(s, d):
    return robots.crawl_delay(_supplied(s, d), "cairn")


# read models ----------------------------------------------------------------------------------------------------------
@query(f"""WITH p AS (SELECT DISTINCT lane, layer, id, p_name FROM ({_PL}) JOIN part ON id = p_partkey),
    g AS (SELECT lane, layer, count(*) AS n, string_agg(p_name, ' | ' ORDER BY lower(p_name), id) AS m FROM p GROUP BY ALL)
    SELECT layers.lane, layers.layer, layers.ord, coalesce(n, 0) AS n_products, coalesce(m, '') AS members FROM {_L} LEFT JOIN g ON g.lane = layers.lane AND g.layer = layers.layer""")
def map_model(s, d):
    return readmodels.map_model(_products(s, d), _placements(s, d), _layers(s))


@query(f"""WITH p AS (SELECT DISTINCT lane, layer, id, p_name AS name FROM ({_PL}) JOIN part ON id = p_partkey)
    SELECT p.lane, p.layer, row_number() OVER (PARTITION BY p.lane, p.layer ORDER BY lower(name), id) AS place, id, name FROM p JOIN {_L} ON p.lane = layers.lane AND p.layer = layers.layer""")
def map_members(s, d):
    return readmodels.map_members(_products(s, d), _placements(s, d), _layers(s))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unplaced_products(s, d):
    placed = t(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return readmodels.unplaced(_products(s, d), placed)


@query(f"""WITH w AS (SELECT id, string_agg(DISTINCT lane || '/' || layer, ',' ORDER BY lane || '/' || layer) AS placements FROM ({_PL}) GROUP BY 1)
    SELECT p_partkey AS id, p_name AS name, placements, CASE WHEN p_size > 25 THEN p_type END AS note, CASE WHEN p_size <= 25 THEN p_retailprice END AS price FROM part LEFT JOIN w ON id = p_partkey""")
def product_panel(s, d):
    part = t(s, d, "part")
    notes = part.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("note"))
    prices = part.where("p_size <= 25").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    return readmodels.panel(_products(s, d), _placements(s, d), notes, prices)


@query("SELECT s_suppkey AS solution, s_name, n AS member_count FROM supplier LEFT JOIN (SELECT l_suppkey, count(p_partkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0) LEFT JOIN part ON l_partkey = p_partkey AND p_size <= 25 GROUP BY 1) ON l_suppkey = s_suppkey")
def solution_cards(s, d):
    solutions = t(s, d, "supplier").select(F.col("s_suppkey").alias("solution"), "s_name")
    known = t(s, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    return readmodels.solution_cards(solutions, t(s, d, "lineitem").where("l_quantity = 50 AND l_discount = 0").select(F.col("l_suppkey").alias("solution"), F.col("l_partkey").alias("id")), known)


@query("WITH p AS (SELECT DISTINCT l_suppkey AS solution, l_partkey AS id FROM lineitem) SELECT solution, id, count(*) OVER (PARTITION BY id) - 1 AS n_shared FROM p")
def focus_shared_with(s, d):
    return readmodels.shared_with(_members(s, d))


@query("WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS id FROM lineitem) SELECT s AS solution, count(*) AS n_shared FROM p WHERE s <> 1 AND id IN (SELECT id FROM p WHERE s = 1) GROUP BY 1")
def shared_solutions(s, d):
    return readmodels.shared_solutions(_members(s, d), 1)


def _boundaries(s, d):
    sup = t(s, d, "supplier")
    return sup.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") % 5 + 1).alias("b"), F.col("s_name").alias("note")).where("a <> b")


@query("""WITH x AS (SELECT s_suppkey AS a, s_suppkey % 5 + 1 AS b, s_name AS note FROM supplier WHERE s_suppkey <> s_suppkey % 5 + 1),
    u AS (SELECT *, 0 AS pri FROM x UNION ALL SELECT b, a, note, 1 FROM x), m AS (SELECT a, b, arg_min(note, (pri, note)) AS note FROM u GROUP BY a, b),
    p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS id FROM lineitem), c AS (SELECT one.s AS a, two.s AS b, count(*) AS n FROM p one JOIN p two ON one.id = two.id GROUP BY 1, 2)
    SELECT m.a, m.b, note, coalesce(n, 0) AS n_common FROM m LEFT JOIN c ON m.a = c.a AND m.b = c.b""")
def solution_boundaries(s, d):
    return readmodels.boundary_overlap(_boundaries(s, d), _members(s, d))


@query("""SELECT 'scenario' AS kind, 0 AS kind_ord, r_regionkey::BIGINT AS key, r_name AS title, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_products FROM region
    UNION ALL SELECT 'solution', 1, s_suppkey, s_name, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) FROM supplier""")
def lens_union(s, d):
    nations = t(s, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n_products"))
    scenarios = t(s, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("title"), F.coalesce("n_products", F.lit(0)).alias("n_products"))
    sizes = _members(s, d).groupBy("solution").agg(F.count_distinct("id").alias("n_products"))
    solutions = t(s, d, "supplier").join(sizes, F.col("s_suppkey") == F.col("solution"), "left").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("title"), F.coalesce("n_products", F.lit(0)).alias("n_products"))
    return readmodels.lens_views(scenarios, solutions)


@query("WITH a AS (SELECT l_returnflag AS lane, l_linestatus AS layer, min(l_orderkey * 10 + l_linenumber) AS first_ord, count(*) AS slots FROM lineitem GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY lane ORDER BY first_ord, layer) AS place FROM a")
def areas_first_seen(s, d):
    rows = t(s, d, "lineitem").select(F.col("l_returnflag").alias("lane"), F.col("l_linestatus").alias("layer"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return readmodels.areas(rows, "o").withColumn("place", F.col("place").cast("long"))


@query("""WITH k AS (SELECT n_nationkey, n_regionkey, -pi() / 2 + 2 * pi() * (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) / count(*) OVER (PARTITION BY n_regionkey) AS a FROM nation)
    SELECT n_nationkey, n_regionkey, floor(360.0::DOUBLE + 0.38::DOUBLE * 720 * cos(a) + 0.5::DOUBLE)::BIGINT AS x, floor(260.0::DOUBLE + 0.36::DOUBLE * 520 * sin(a) + 0.5::DOUBLE)::BIGINT AS y,
    CASE WHEN cos(a) > 0.3 THEN 'start' WHEN cos(a) < -0.3 THEN 'end' ELSE 'middle' END AS anchor FROM k""")
def radial_layout(s, d):
    return readmodels.radial_layout(t(s, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", ["n_nationkey"], 720.0, 520.0)


# pricing --------------------------------------------------------------------------------------------------------------
TIERS = [("free", 1, 0.0), ("paid", 2, 5.0), ("enterprise", 3, None)]
METERS = [("paid", 1, "qty", "Quantity", 100.0, 10, 0.3), ("paid", 2, "lines", "Lines", 2.0, 1, 0.05), ("enterprise", 1, "qty", "Volume", 500.0, 10, 0.1)]


def _tiers(s, d):
    rows = s.createDataFrame(TIERS, "tier string, pos int, monthly double")
    return t(s, d, "supplier").select(F.col("s_suppkey").alias("product")).crossJoin(F.broadcast(rows))  # three rows


def _meters(s, d):
    rows = s.createDataFrame(METERS, "tier string, mpos int, metric string, label string, included double, per_units int, usd double")
    return t(s, d, "supplier").select(F.col("s_suppkey").alias("product")).crossJoin(F.broadcast(rows))  # three rows


def _usage(s, d):
    sums = t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("product")).agg(F.sum("l_quantity").alias("qty"), F.count("*").cast("double").alias("lines"), F.sum("l_linenumber").cast("double").alias("numbers"))
    return sums.unpivot("product", ["qty", "lines", "numbers"], "metric", "amount")


_TIER_ROWS = "ti(tier, pos, monthly) AS (VALUES ('free', 1, 0.0), ('paid', 2, 5.0), ('enterprise', 3, NULL)), me(tier, mpos, metric, label) AS (VALUES ('paid', 1, 'qty', 'Quantity'), ('paid', 2, 'lines', 'Lines'), ('enterprise', 1, 'qty', 'Volume'))"
_USE = "u AS (SELECT l_suppkey AS product, sum(l_quantity)::DOUBLE AS qty, count(*)::DOUBLE AS lines FROM lineitem GROUP BY 1)"
_CENTS = lambda x: f"floor(({x}) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE"
_EST = f"""WITH {_USE}, e AS (SELECT s_suppkey AS product, 'free' AS tier, 0.0::DOUBLE AS total FROM supplier
    UNION ALL SELECT s_suppkey, 'paid', {_CENTS(f"5.0::DOUBLE + {_CENTS('greatest(0, coalesce(qty, 0) - 100::DOUBLE) / 10 * 0.3::DOUBLE')} + {_CENTS('greatest(0, coalesce(lines, 0) - 2::DOUBLE) / 1 * 0.05::DOUBLE')}")} FROM supplier LEFT JOIN u ON product = s_suppkey
    UNION ALL SELECT s_suppkey, 'enterprise', NULL FROM supplier) """


@query(_EST + "SELECT * FROM e")
def tier_estimates(s, d):
    return pricing.tier_estimates(_tiers(s, d), _meters(s, d), _usage(s, d)).select("product", "tier", "total")


# suppliers in debt don't name what they meter
@query(f"WITH {_TIER_ROWS}, m AS (SELECT metric, arg_min(label, (pos, mpos)) AS label, min(pos * 1000 + mpos) AS place FROM me JOIN ti USING (tier) GROUP BY 1) SELECT s_suppkey AS product, metric, CASE WHEN s_acctbal < 0 THEN metric ELSE label END AS label, place FROM supplier, m")
def usage_metrics_first_seen(s, d):
    debts = t(s, d, "supplier").select(F.col("s_suppkey").alias("product"), (F.col("s_acctbal") < 0).alias("_debt"))
    meters = _meters(s, d).join(debts, "product").withColumn("label", F.when(~F.col("_debt"), F.col("label"))).drop("_debt")
    return pricing.usage_metrics(_tiers(s, d), meters).withColumn("place", F.col("place.pos") * 1000 + F.col("place.mpos"))


@query(f"""WITH {_USE}, {_TIER_ROWS}, un AS (SELECT l_suppkey AS product, unnest(['qty', 'lines', 'numbers']) AS metric, unnest([sum(l_quantity), count(*), sum(l_linenumber)]) AS amount FROM lineitem GROUP BY l_suppkey)
    SELECT product, tier, metric FROM un, ti WHERE amount > 0 AND product IN (SELECT s_suppkey FROM supplier) AND (tier, metric) NOT IN (SELECT (tier, metric) FROM me)""")
def uncovered_metrics(s, d):
    return pricing.uncovered(_tiers(s, d), _meters(s, d), _usage(s, d))


# suppliers of small accounts have no meters, those in debt no tiers at all
@query(f"WITH {_TIER_ROWS} SELECT s_suppkey AS product, CASE WHEN s_acctbal < 0 THEN '' WHEN s_acctbal < 1000 THEN (SELECT arg_min(tier, pos) FROM ti) ELSE (SELECT arg_min(tier, pos) FROM ti WHERE tier IN (SELECT tier FROM me)) END AS tier FROM supplier")
def default_tier(s, d):
    having = lambda test: t(s, d, "supplier").where(test).select(F.col("s_suppkey").alias("product"))
    tiers, meters = _tiers(s, d).join(having("s_acctbal >= 0"), "product", "left_semi"), _meters(s, d).join(having("s_acctbal >= 1000"), "product", "left_semi")
    return pricing.default_tier(tiers, meters, having("true"))


@query(_EST.rstrip() + ", x AS (SELECT s_suppkey AS product, CASE s_suppkey % 4 WHEN 0 THEN 'enterprise' WHEN 1 THEN 'nothing' ELSE 'paid' END AS tier FROM supplier) SELECT product, tier FROM x LEFT JOIN e USING (product, tier) WHERE total IS NULL")
def excluded_products(s, d):
    chosen = F.when(F.col("product") % 4 == 0, "enterprise").when(F.col("product") % 4 == 1, "nothing").otherwise("paid")
    selections = t(s, d, "supplier").select(F.col("s_suppkey").alias("product")).withColumn("tier", chosen)
    return pricing.excluded(selections, pricing.tier_estimates(_tiers(s, d), _meters(s, d), _usage(s, d)))


@query(_EST.rstrip() + ", x AS (SELECT s_suppkey AS product, CASE s_suppkey % 4 WHEN 0 THEN 'enterprise' WHEN 1 THEN 'nothing' ELSE 'paid' END AS tier FROM supplier) SELECT coalesce(sum(floor(total * 100 + 0.5)::BIGINT), 0)::DOUBLE / 100 AS total, count(*) FILTER (total IS NULL) AS n_excluded FROM x LEFT JOIN e USING (product, tier)")
def combined_estimate(s, d):
    chosen = F.when(F.col("product") % 4 == 0, "enterprise").when(F.col("product") % 4 == 1, "nothing").otherwise("paid")
    selections = t(s, d, "supplier").select(F.col("s_suppkey").alias("product")).withColumn("tier", chosen)
    return pricing.combined(selections, pricing.tier_estimates(_tiers(s, d), _meters(s, d), _usage(s, d)))


# recall ---------------------------------------------------------------------------------------------------------------
def _recall(s, d):
    part = t(s, d, "part")
    placements = part.select(F.lit("all").alias("lane"), F.col("p_size").cast("string").alias("layer"), F.col("p_partkey").alias("id"))
    layers = part.select(F.lit("all").alias("lane"), F.col("p_size").cast("string").alias("layer"), F.col("p_size").alias("ord")).distinct()
    return recall.recall_pool(_products(s, d), placements, layers)


@query("""WITH o AS (SELECT p_size, lag(p_size) OVER (ORDER BY p_size) AS a, lead(p_size) OVER (ORDER BY p_size) AS b FROM (SELECT DISTINCT p_size FROM part)),
    c AS (SELECT o.p_size, p_partkey AS id, p_name AS name, row_number() OVER (PARTITION BY o.p_size ORDER BY lower(p_name), p_partkey) AS r FROM o JOIN part p ON p.p_size IN (o.a, o.b)),
    k AS (SELECT p_size, greatest(2, floor(count(*) * 0.3::DOUBLE + 0.5)::INT) AS k FROM part GROUP BY 1)
    SELECT 'all' AS lane, p_size::VARCHAR AS layer, p_partkey AS id, p_name AS name, true AS is_answer FROM part
    UNION ALL SELECT 'all', c.p_size::VARCHAR, id, name, false FROM c JOIN k ON c.p_size = k.p_size AND r <= k""")
def recall_pool_decoys(s, d):
    return _recall(s, d)


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE len(list_filter(regexp_split_to_array(lower(p_name), '[\\s/-]+'), lambda w: starts_with(w, 'rin'))) > 0 OR starts_with(p_partkey::VARCHAR, 'rin') ORDER BY lower(p_name), p_partkey LIMIT 8")
def suggest_prefix(s, d):
    return recall.suggest(_products(s, d), "rin")


@query("""WITH a AS (SELECT DISTINCT event_type AS area, user_id AS id FROM events WHERE value < 60), p AS (SELECT DISTINCT event_type AS area, user_id AS id FROM events WHERE value > 50),
    c AS (SELECT area, count(a.id) AS n_answers, count(*) FILTER (a.id IS NOT NULL AND p.id IS NOT NULL) AS n_correct, count(*) FILTER (a.id IS NULL) AS n_wrong FROM a FULL JOIN p USING (area, id) GROUP BY 1)
    SELECT *, CASE WHEN n_wrong > n_correct THEN 'practice' ELSE 'verify' END AS kind, CASE WHEN n_wrong > n_correct THEN 'none' WHEN n_answers > 0 AND n_correct / n_answers >= 0.8 THEN 'verify' ELSE 'demote' END AS effect FROM c""")
def score_recall(s, d):
    e = t(s, d, "events")
    rows = lambda c: e.where(c).select(F.col("event_type").alias("area"), F.col("user_id").alias("id")).distinct()
    return recall.score(rows("value < 60"), rows("value > 50")).withColumn("effect", recall.compose_effect())


# progress -------------------------------------------------------------------------------------------------------------
_REVIEW = """WITH b AS (SELECT {keys}, ts, event_id, sum(CASE WHEN value >= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS f FROM events),
    g AS (SELECT {keys}, arg_max(ts::DATE, (ts, event_id)) AS last, count(*) FILTER (f = 0) AS streak FROM b GROUP BY ALL),
    r AS (SELECT {keys}, last, streak, last + [1, 4, 14][least(greatest(streak, 1), 3)]::INT AS due FROM g) """


def _reviews(s, d, keys):
    log = t(s, d, "events").select(*keys, "ts", "event_id", F.to_date("ts").alias("date"), (F.col("value") >= 5).alias("success"))
    out = progress.review_states(log, keys, ["ts", "event_id"], "date", "success", TODAY)
    return out.withColumn("last", F.col("last").cast("string")).withColumn("due", F.col("due").cast("string"))


_OUT = f"strftime(last, '%Y-%m-%d') AS last, streak, strftime(due, '%Y-%m-%d') AS due, due <= DATE '{TODAY}' AS stale FROM r"


@query(_REVIEW.format(keys="event_type") + "SELECT event_type, " + _OUT)
def area_review_states(s, d):
    return _reviews(s, d, ["event_type"])


@query(_REVIEW.format(keys="user_id, event_type") + "SELECT user_id, event_type, " + _OUT)
def node_review_states(s, d):
    return _reviews(s, d, ["user_id", "event_type"])


@query("SELECT user_id, count(DISTINCT ts::DATE) AS n_days FROM events GROUP BY 1")
def session_days(s, d):
    return progress.session_days(t(s, d, "events"), "user_id", F.to_date("ts"))


def _kinds(df):
    kind = F.when(F.col("event_type") == "view", "visit").when(F.col("event_type") == "click", "mark").when(F.col("event_type") == "signup", "practice-hit").when(F.col("event_type") == "purchase", "verify-hit").otherwise(F.when(F.col("value") < 20, "verify-miss").otherwise("practice-miss"))
    return df.withColumn("kind", kind).withColumn("node", F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string")))


_NODES = """WITH e AS (SELECT user_id || ':' || event_id % 3 AS node, event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS r,
        event_type = 'purchase' AS hit, event_type = 'error' AND value < 20 AS miss FROM events),
    m AS (SELECT *, max(CASE WHEN miss THEN event_id END) OVER (PARTITION BY node) AS m FROM e),
    g AS (SELECT node, max(CASE WHEN m IS NULL OR event_id > m THEN r ELSE least(r, 1) END) AS r, count(*) FILTER (hit AND (m IS NULL OR event_id > m)) AS streak FROM m GROUP BY 1),
    n AS (SELECT node, ['absent', 'visited', 'marked', 'verified'][r + 1] AS status, streak FROM g) """


@query(_NODES + "SELECT * FROM n")
def node_state_fold(s, d):
    return progress.node_states(_kinds(t(s, d, "events")), ["node"], ["event_id"])


@query(_NODES + "SELECT status, count(*) AS n FROM n WHERE status <> 'absent' GROUP BY 1")
def status_counts(s, d):
    return progress.status_counts(progress.node_states(_kinds(t(s, d, "events")), ["node"], ["event_id"]))


@query("SELECT (SELECT count(*) FROM part) AS products, (SELECT count(*) FROM supplier) AS solutions, (SELECT count(*) FROM lineitem) AS slots, (SELECT count(*) FROM events WHERE event_type = 'purchase') / (SELECT count(*) FROM events)::DOUBLE AS recall_rate")
def report_row(s, d):
    one = lambda n: t(s, d, n).agg(F.count("*").alias("n"))
    rate = t(s, d, "events").agg(F.try_divide(F.count_if(F.col("event_type") == "purchase"), F.count("*")).alias("recall_rate"))
    return one("part").toDF("products").crossJoin(one("supplier").toDF("solutions")).crossJoin(one("lineitem").toDF("slots")).crossJoin(rate)  # one row each


# curated shapes and scenarios -----------------------------------------------------------------------------------------
LANE_LAYERS = {"A": ["F", "O"], "N": ["F"], "R": ["O"]}


@query("""WITH p AS (SELECT p_partkey - 1 AS ord, p_size AS n, 'products[' || p_partkey - 1 || ']' AS base FROM part),
    i(path, message, ord) AS (SELECT base || '.productId', 'slug', ord FROM p WHERE n % 3 = 0
        UNION ALL SELECT base || '.roleKo', 'text', ord FROM p WHERE n % 11 = 0
        UNION ALL SELECT base || '.placements', 'list', ord FROM p WHERE n % 13 = 0
        UNION ALL SELECT base || '.placements', 'distinct', ord FROM p WHERE n % 13 <> 0 AND n % 4 = 0
        UNION ALL SELECT base || '.placements[1].layer', 'layer', ord FROM p WHERE n % 13 <> 0 AND n % 4 = 1
        UNION ALL SELECT base || '.sourceUrl', 'url', ord FROM p WHERE n % 5 = 0
        UNION ALL SELECT base || '.verifiedAt', 'instant', ord FROM p WHERE n % 7 = 0)
    SELECT 'invalid-shape' AS code, * FROM i""")
def curated_product_issues(s, d):
    place = lambda lane, layer: F.struct(F.lit(lane).alias("lane"), F.lit(layer).alias("layer"))
    n = F.col("p_size")
    second = F.when(n % 4 == 0, place("A", "F")).when(n % 4 == 1, place("N", "O")).otherwise(place("R", "O"))
    rows = t(s, d, "part").select(
        (F.col("p_partkey") - 1).alias("ord"),
        F.concat(F.when(n % 3 == 0, "Part ").otherwise("part-"), F.col("p_partkey").cast("string")).alias("productId"),
        F.when(n % 11 == 0, "  ").otherwise(F.col("p_type")).alias("roleKo"),
        F.filter(F.array(place("A", "F"), second), lambda x: F.col("p_size") % 13 != 0).alias("placements"),
        F.concat(F.when(n % 5 == 0, "http").otherwise("https"), F.lit(f"://{HOSTS[0]}/x")).alias("sourceUrl"),
        F.concat(F.lit("2024-01-01T00:00:00"), F.when(n % 7 == 0, "").otherwise("Z")).alias("verifiedAt"),
    )
    return curated.shape_issues(rows, "products", HOSTS, LANE_LAYERS)


_SCENARIO = """WITH e AS (SELECT event_id, user_id % 30 AS a, (event_id + 7) % 30 AS b, event_type, round(value) - 20 AS v FROM events),
    k AS (SELECT event_id, a, b, event_type, v, a IN (SELECT s_suppkey FROM supplier) AS has_a, b IN (SELECT s_suppkey FROM supplier) AND a <> b AS has_b FROM e),
    r AS (SELECT event_id, 0 AS pos, a::VARCHAR AS product, CASE WHEN event_type IN ('view', 'click') THEN 'paid' END AS tier, CASE WHEN v > 0 THEN v::DOUBLE END AS qty FROM k WHERE has_a
        UNION ALL SELECT event_id, 1, b::VARCHAR, NULL, NULL FROM k WHERE has_b) """


def _scenarios(s, d):
    a, b = (F.col("user_id") % 30).cast("string"), ((F.col("event_id") + 7) % 30).cast("string")
    tier = F.when(F.col("event_type").isin("view", "click"), "paid").otherwise("none")
    amount = (F.round("value") - 20).cast("string")
    q = F.concat(F.lit("products="), a, F.lit("%2C+"), b, F.lit(",,"), a, F.lit("&t."), a, F.lit("="), tier, F.lit("&u."), a, F.lit(".qty="), amount, F.lit("&u."), a, F.lit(".nothing=5&t."), a, F.lit("=free"))
    tiers, meters = (x.withColumn("product", F.col("product").cast("string")) for x in (_tiers(s, d), _meters(s, d)))
    return scenario.settings(t(s, d, "events").select("event_id", q.alias("q")), "event_id", "q", tiers, meters)


@query(_SCENARIO + "SELECT * FROM r")
def scenario_settings(s, d):
    return _scenarios(s, d).select("event_id", "pos", "product", "tier", F.try_element_at("usage", F.lit("qty")).alias("qty"))


@query(_SCENARIO + """SELECT event_id, 'products=' || string_agg(product, ',' ORDER BY pos) || coalesce('&' || string_agg('t.' || product || '=' || tier, '&' ORDER BY pos), '')
    || coalesce('&' || string_agg('u.' || product || '.qty=' || qty::BIGINT, '&' ORDER BY pos), '') AS query FROM r GROUP BY 1""")
def scenario_query_strings(s, d):
    return scenario.serialize(_scenarios(s, d), "event_id")


# pages of the five kinds ----------------------------------------------------------------------------------------------
@query("SELECT page_id, 'none' AS kind, 'none of the kinds fit' AS issue FROM pages")
def parsed_pages(s, d):
    return page_parsers.parse(t(s, d, "pages")).select("page_id", "kind", "issue")


def _page(path: str, page_id: str, body) -> tuple:
    """url and html of a page; every fifth has the canonical link of another page, every seventh no description."""
    k = F.col(page_id)
    link = F.when(k % 5 == 4, F.lit("/elsewhere")).otherwise(F.concat(F.lit(path), k.cast("string")))
    about = F.when(k % 7 == 6, "").otherwise('<meta name="description" content="What there is.">')
    html = F.concat(F.lit("<html><head><title> A\n page </title><link rel=canonical href='"), link, F.lit("'>"), about, F.lit("</head><body>"), body, F.lit("</body></html>"))
    return F.concat(F.lit(f"https://{HOSTS[0]}{path}"), k.cast("string")).alias("url"), html.alias("html")


@query(f"""WITH c AS (SELECT o_orderkey AS page_id, o_orderstatus AS "group", unnest(['One ' || o_custkey, 'Two ' || o_custkey]) AS name, unnest([CASE WHEN o_totalprice > 250000 THEN 'Key ' || o_custkey END, 'Much']) AS summary, unnest(['https://{HOSTS[0]}/products/1-' || o_custkey, 'https://{HOSTS[0]}/products/2-' || o_custkey]) AS href, unnest([0, 1]) AS pos FROM orders)
    SELECT page_id, 'products-overview' AS kind, pos, "group", name, summary, href FROM c WHERE page_id % 5 <> 4 AND page_id % 7 <> 6""")
def parsed_product_cards(s, d):
    """An overview page per order, of one family and two products."""
    k = F.col("o_custkey").cast("string")
    about = F.when(F.col("o_totalprice") > 250000, F.concat(F.lit("<p> Key  "), k, F.lit("</p>"))).otherwise("")
    card = lambda n, name, about: F.concat(F.lit(f'<a href="/products/{n}-'), k, F.lit(f'"><div><strong>{name} '), k, F.lit("</strong></div>"), about, F.lit("</a>"))
    body = F.concat(F.lit("<figure><figcaption>"), F.col("o_orderstatus"), F.lit("</figcaption>"), card(1, "One", about), card(2, "Two", F.lit("<p>Much</p>")), F.lit("</figure>"))
    made = t(s, d, "orders").select(F.col("o_orderkey").alias("page_id"), *_page("/orders/", "o_orderkey", body))
    return page_parsers.cards(page_parsers.parse(made))


@query("""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 7 <> 6 AND p_size > 10 THEN CASE WHEN p_size > 30 THEN 2 ELSE 1 END END AS n_cards,
        CASE WHEN p_partkey % 5 = 4 THEN 'canonical link of another page' WHEN p_partkey % 7 = 6 THEN 'no description' WHEN p_size <= 10 THEN 'no cards' END AS issue FROM part""")
def parsed_docs_pages(s, d):
    """A directory page per part; entries without text are navigation."""
    entry = lambda path, shown: F.concat(F.lit(f'<a href="/{path}">'), F.when(shown, F.concat(F.lit("<span>"), F.col("p_name"), F.lit("</span><p>About</p>"))).otherwise("Menu"), F.lit("</a>"))
    body = F.concat(F.lit("<main data-pagefind-body>"), entry("one", F.col("p_size") > 10), entry("two", F.col("p_size") > 30), F.lit("</main>"))
    made = t(s, d, "part").select(F.col("p_partkey").alias("page_id"), *_page("/parts/", "p_partkey", body))
    parsed = page_parsers.parse(made)
    return parsed.select("page_id", F.when(F.col("cards").isNotNull(), F.size("cards")).alias("n_cards"), "issue")
