"""Registered queries written in SQL alone, over the views and functions of ``cairn.sql``, each with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import sql
from cairn.plans import catalog_queries, learning_queries
from cairn.plans.registry import query, t


def _installed(s, d) -> None:
    text = lambda rows, *columns: rows.withColumns({c: F.col(c).cast("string") for c in columns})
    events = learning_queries._events(s, d).withColumnRenamed("event_id", "ord")
    products = learning_queries._products(s, d)
    sql.install(s, {
        "products": products, "placements": learning_queries._placements(s, d), "solutions": learning_queries._solutions(s, d), "members": learning_queries._members(s, d), "boundaries": learning_queries._bounds(s, d), "events": events,
        "tiers": text(catalog_queries._tiers(s, d), "product"), "meters": text(catalog_queries._meters(s, d), "product"), "usage": text(catalog_queries._usage(s, d), "product"),
    })


@query(f"WITH {learning_queries._STATES} SELECT node, status, streak, strftime(last + [1, 4, 14][least(greatest(streak, 1), 3)]::INT, '%Y-%m-%d') AS due FROM st WHERE last IS NOT NULL AND last + [1, 4, 14][least(greatest(streak, 1), 3)]::INT <= DATE '2024-01-31'")
def sql_due_nodes(s, d):
    _installed(s, d)
    return s.sql("SELECT n.node, n.status, n.streak, date_format(f.due, 'yyyy-MM-dd') AS due FROM due_nodes(DATE '2024-01-31') f JOIN node_states n ON n.node = f.node")


@query("SELECT n.n_nationkey AS nation, p_partkey::VARCHAR AS id, p_name AS name FROM nation n JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) m ON m.l_suppkey = n.n_nationkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) o ON o.l_suppkey = n.n_nationkey + 1 AND o.l_partkey = m.l_partkey JOIN part ON p_partkey = m.l_partkey")
def sql_shared_products(s, d):
    _installed(s, d)
    t(s, d, "nation").createOrReplaceTempView("nation_keys")
    return s.sql("""WITH pair AS (SELECT n_nationkey AS nation, cast(n_nationkey AS STRING) AS one, cast(n_nationkey + 1 AS STRING) AS two FROM nation_keys),
        both AS (SELECT DISTINCT nation, m.id FROM pair JOIN members m ON m.solution = one JOIN members o ON o.solution = two AND o.id = m.id) SELECT nation, p.id, p.name FROM both JOIN products p ON p.id = both.id""")


@query("SELECT DISTINCT l_returnflag AS lane, p_partkey::VARCHAR AS id, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'R')")
def sql_products_in(s, d):
    _installed(s, d)
    return s.sql("SELECT 'A' AS lane, * FROM products_in('A', 'F') UNION ALL SELECT 'R', * FROM products_in('R', 'F')")
