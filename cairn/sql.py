"""The catalog and a learner's record in SQL: temporary views and SQL functions of the session, all expanded into the query's plan.

``install`` makes views of the tables it is given and of the read models over them, and functions of a value or of a table.
A read model is planned when it is queried and is no snapshot: what a query doesn't ask for is not computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.operators import pricing, progress
from cairn.operators.progress import INTERVALS

#: Tables and the columns that views and functions ask of them. All are needed.
TABLES = {
    "products": "id, name, family_id", "placements": "id, lane, layer", "solutions": "id, name", "members": "solution, id", "boundaries": "a, b, note",
    "events": "node, ord, day, kind", "tiers": "product, tier, pos, monthly", "meters": "product, tier, mpos, metric, label, included, per_units, usd", "usage": "product, metric, amount",
}

_DAYS = f"array({', '.join(map(str, INTERVALS))})"
VALUES = {
    "collapse_ws(t STRING)": ("STRING", r"trim(regexp_replace(t, '\\s+', ' '))"),
    "round_cents(x DOUBLE)": ("DOUBLE", "floor(x * 100 + 0.5) / 100"),
    "is_success(correct DOUBLE, total DOUBLE)": ("BOOLEAN", "coalesce(total > 0 AND correct / total >= 0.8, false)"),
    "review_due(last DATE, streak BIGINT)": ("DATE", f"date_add(last, element_at({_DAYS}, cast(least(greatest(streak, 1), {len(INTERVALS)}) AS INT)))"),
}
TABLE_FUNCTIONS = {
    "products_in(in_lane STRING, in_layer STRING)": ("id STRING, name STRING", "SELECT DISTINCT p.id, p.name FROM products p JOIN placements l ON l.id = p.id WHERE l.lane = in_lane AND l.layer = in_layer"),
    "solutions_with(product STRING)": ("solution STRING, name STRING", "SELECT DISTINCT m.solution, coalesce(s.name, m.solution) FROM members m LEFT JOIN solutions s ON s.id = m.solution WHERE m.id = product"),
    "shared_products(one STRING, two STRING)": ("id STRING, name STRING", "SELECT DISTINCT m.id, coalesce(p.name, m.id) FROM members m JOIN members o ON o.id = m.id LEFT JOIN products p ON p.id = m.id WHERE m.solution = one AND o.solution = two"),
    "suggest(text STRING)": ("id STRING, name STRING", r"""SELECT id, name FROM products WHERE CASE WHEN length(trim(text)) = 0 THEN false WHEN length(trim(text)) < 3 THEN lower(name) = lower(trim(text)) OR id = lower(trim(text))
        ELSE exists(split(lower(name), '[\\s/-]+'), w -> startswith(w, lower(trim(text)))) OR exists(split(lower(id), '-'), w -> startswith(w, lower(trim(text)))) END ORDER BY lower(name), id LIMIT 8"""),
    "due_nodes(today DATE)": ("node STRING, due DATE", "SELECT node, review_due(last, streak) FROM node_states WHERE last IS NOT NULL AND review_due(last, streak) <= today"),
}


def install(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Makes the views and functions of this session from tables with the columns of ``TABLES``."""
    for name, columns in TABLES.items():
        tables[name].select(*columns.split(", ")).createOrReplaceTempView(name)
    t = {name: spark.table(name) for name in TABLES}
    progress.node_states(t["events"], ["node"], ["ord"], date="day").createOrReplaceTempView("node_states")
    progress.opened(t["events"], ["node"], ["ord"]).createOrReplaceTempView("opened_cards")
    pricing.tier_estimates(t["tiers"], t["meters"], t["usage"]).createOrReplaceTempView("tier_estimates")
    pricing.default_tier(t["tiers"], t["meters"], t["products"].withColumnRenamed("id", "product")).createOrReplaceTempView("default_tiers")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW map_members AS SELECT DISTINCT lane, layer, id, name, family_id FROM placements JOIN products USING (id)")
    spark.sql("""CREATE OR REPLACE TEMPORARY VIEW solution_boundaries AS SELECT a AS solution, b AS neighbour, min_by(note, struct(side, note)) AS note
        FROM (SELECT a, b, note, 0 AS side FROM boundaries UNION ALL SELECT b, a, note, 1 FROM boundaries) WHERE a <> b GROUP BY a, b""")
    for head, (kind, body) in VALUES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for head, (columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE ({columns}) RETURN {body}")
