"""Assembling only what changed, against assembling everything."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from cairn.operators import assemble
from cairn.operators.claims import Claims

SCHEMAS = {
    "sources": "id string, url string, page_kind string, title string, retrieved_at string, precedence int", "families": "source string, id string, name string",
    "products": "source string, key string, id string, name string, summary string, family_id string", "solutions": "source string, key string, id string, name string, summary string",
    "use_cases": "source string, id string, name string, summary string", "edges": "source string, type string, from_id string, to_id string", "docs": "source string, slug string", "problems": "source string, url string, message string",
}


def made(spark, n=200) -> dict:
    """Claims of n product pages, each with a use case, of an overview a hundred products, and of a docs page."""
    rows = {name: [] for name in SCHEMAS}
    for k in range(n):
        page, over = f"page-{k}", f"over-{k // 100}"
        rows["sources"].append((page, f"u/{k}", "marketing-product", "t", "r", 1))
        rows["products"] += [(page, f"/p/{k}", f"p-{k}", None, f"about {k}", None), (over, f"/p/{k}", f"p-{k}", f"P {k}", "short", "fam")]
        rows["use_cases"].append((page, f"use-{k % 50}", f"U {k % 50}", "all"))
        rows["edges"].append((page, "product-use-case", f"p-{k}", f"use-{k % 50}"))
    for k in range((n + 99) // 100):
        rows["sources"].append((f"over-{k}", f"o/{k}", "marketing-overview", "t", "r", 0))
        rows["families"].append((f"over-{k}", "fam", "Fam"))
    rows["sources"].append(("docs", "d", "developer-docs", "t", "r", 0))
    rows["docs"] = [("docs", "p-3"), ("docs", None)]
    rows["solutions"].append(("page-0", "/s/1", "s-1", "S", "s"))
    return rows


def claims(spark, rows) -> Claims:
    return Claims(**{name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()})


def same(one: dict, two: dict) -> None:
    for name in one:
        key = lambda r: str(sorted(r.asDict().items()))
        assert sorted(map(key, one[name].collect())) == sorted(map(key, two[name].collect())), name


def changes(rows):
    rewritten = {k: list(v) for k, v in rows.items()}
    rewritten["products"] = [(s, k, i, n, "new words" if s == "page-7" else x, f) for s, k, i, n, x, f in rows["products"]]
    yield "a page's summary", rewritten, {"products": {"/p/7"}, "useCases": set(), "relationships": {("product-use-case", "p-7", "use-7")}}
    gone = {k: [r for r in v if "page-9" not in r] for k, v in rows.items()}
    gone["products"] = [r for r in gone["products"] if r[1] != "/p/9"]
    yield "a page gone", gone, {"products": {"/p/9"}, "useCases": {"use-9"}}
    docs = {**rows, "docs": [("docs", "p-3"), ("docs", "p-4")]}
    yield "a new docs entry", docs, {"products": {"/p/4"}, "useCases": set()}
    lost = {**rows, "use_cases": [r for r in rows["use_cases"] if r[1] != "use-5"]}
    yield "a use case that edges still name", lost, {"products": set(), "useCases": {"use-5"}}
    renamed = {**rows, "products": [(s, k, "other" if k == "/p/2" else i, n, x, f) for s, k, i, n, x, f in rows["products"]]}
    yield "another id", renamed, {"products": {"/p/2"}}
    yield "nothing", rows, {"products": set(), "useCases": set(), "relationships": set()}


@pytest.mark.parametrize("which", range(6))
def test_refreshed_equals_a_full_run(spark, which):
    rows = made(spark)
    before = claims(spark, rows)
    catalog, problems = assemble.assembled(before)
    assert problems.isEmpty()
    _, changed, want = list(changes(rows))[which]
    after = claims(spark, changed)
    got, found, touched = assemble.refreshed(before, catalog, after)
    full, all_found = assemble.assembled(after)
    same(full, got)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, all_found.collect()))
    for name, keys in want.items():
        assert {tuple(r) if len(r) > 1 else r[0] for r in touched[name].collect()} == keys, name


def test_one_page_of_twenty_thousand(spark):
    rows = made(spark, 20_000)
    before = claims(spark, rows)
    after = dataclasses.replace(before, products=before.products.withColumn("summary", F.when(F.col("source") == "page-77", "new words").otherwise(F.col("summary"))))
    catalog, _ = assemble.assembled(before)
    got, found, touched = assemble.refreshed(before, catalog, after)
    assert found.isEmpty() and [r.key for r in touched["products"].collect()] == ["/p/77"] and touched["useCases"].isEmpty() and touched["relationships"].count() == 1
    assert got["products"].count() == 20_000 and got["products"].where("summary = 'new words'").first().id == "p-77"


def test_stale_solutions_without_a_composition(spark, tmp_path):
    """Every supplier is asked, one that sold nothing in a first line too; the report asks for the composed ones only."""
    from cairn.plans import learning_queries

    tables = {
        "supplier": spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three")], "s_suppkey long, s_name string"),
        "lineitem": spark.createDataFrame([(1, 50.0, 1), (2, 50.0, 2)], "l_suppkey long, l_quantity double, l_linenumber int"),
        "events": spark.createDataFrame([(7, 1, "purchase"), (8, 2, "purchase"), (9, 3, "error")], "event_id long, user_id long, event_type string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00"))),
    }
    for name, rows in tables.items():
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert {r.id for r in learning_queries.stale_solutions(spark, str(tmp_path)).collect()} == {1, 2}
    assert {r.id for r in learning_queries._stale_of(spark, str(tmp_path), learning_queries._composed(spark, str(tmp_path))).collect()} == {1}
