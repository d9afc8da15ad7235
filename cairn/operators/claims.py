"""From parsed pages to claims: what each page states about families, products, solutions, use cases and edges.

A page is a row of ``page_parsers.parse`` with its source's id and configured kind. What a page doesn't state is null; a
kind that makes no claims of a sort gives no rows. ``normalized`` has everything, ``problems`` what can't be normalized.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import docs_slug, id_from_path, path_key, slugify
from cairn.operators.dimensions import PRECEDENCE
from cairn.sources.page_parsers import KINDS
from cairn.sources.shared import written

PRODUCTS_OVERVIEW, SOLUTIONS_OVERVIEW, PRODUCT, SOLUTION, DOCS = KINDS


@dataclass(frozen=True)
class Claims:
    """sources: id, url, page_kind, title, retrieved_at, precedence. The others have source and what the page states."""

    sources: DataFrame
    families: DataFrame
    products: DataFrame
    solutions: DataFrame
    use_cases: DataFrame
    edges: DataFrame
    docs: DataFrame
    problems: DataFrame


def precedence(kind: Column) -> Column:
    """What a page of this kind weighs when pages disagree."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in PRECEDENCE.items() for x in pair)), kind)


def _cards(pages: DataFrame, *kinds: str) -> DataFrame:
    return pages.where(F.col("kind").isin(*kinds)).select("source", "kind", "canonical_url", F.posexplode("cards").alias("pos", "c")).select("source", "kind", "canonical_url", "pos", "c.*")


def normalized(pages: DataFrame, docs_host: str) -> Claims:
    """The claims of pages (source, page_kind, retrieved_at and the columns of ``page_parsers.parse``) that have no issue.
    Cards without an identity (a link without a path, a name without a letter or digit) are problems, and claim nothing."""
    pages = written(pages.where("issue IS NULL"))  # read by each sort of claim
    null = F.lit(None).cast("string")
    sources = pages.select(F.col("source").alias("id"), F.col("canonical_url").alias("url"), "page_kind", "title", "retrieved_at", precedence(F.col("page_kind")).alias("precedence"))
    own = pages.select("source", "kind", "description", "solution_name", path_key(F.col("canonical_url")).alias("key"), id_from_path(F.col("canonical_url")).alias("id"), F.col("canonical_url").alias("url"))
    linked = _cards(pages, PRODUCTS_OVERVIEW, SOLUTIONS_OVERVIEW).withColumn("key", path_key(F.col("href"))).withColumn("id", id_from_path(F.col("href"))).withColumn("family", slugify(F.col("group")))
    used = _cards(pages, PRODUCT, SOLUTION).withColumn("id", slugify(F.col("name")))
    families = linked.where((F.col("kind") == PRODUCTS_OVERVIEW) & F.col("family").isNotNull()).select("source", F.col("family").alias("id"), F.col("group").alias("name")).distinct()
    cards = linked.where("id IS NOT NULL")
    products = cards.where(F.col("kind") == PRODUCTS_OVERVIEW).select("source", "key", "id", "name", "summary", F.col("family").alias("family_id"))
    products = products.unionByName(own.where((F.col("kind") == PRODUCT) & F.col("id").isNotNull()).select("source", "key", "id", null.alias("name"), F.col("description").alias("summary"), null.alias("family_id")))
    solutions = cards.where(F.col("kind") == SOLUTIONS_OVERVIEW).select("source", "key", "id", "name", "summary")
    solutions = solutions.unionByName(own.where((F.col("kind") == SOLUTION) & F.col("id").isNotNull()).select("source", "key", "id", F.col("solution_name").alias("name"), F.col("description").alias("summary")))
    use_cases = used.where("id IS NOT NULL").select("source", "id", "name", "summary")
    kind = F.when(F.col("kind") == PRODUCT, "product-use-case").otherwise("solution-use-case")
    ends = used.where("id IS NOT NULL").select("source", F.col("id").alias("to_id"))
    edges = own.where(F.col("kind").isin(PRODUCT, SOLUTION) & F.col("id").isNotNull()).select("source", kind.alias("type"), F.col("id").alias("from_id")).join(ends, "source")
    docs = _cards(pages, DOCS).select("source", docs_slug(F.col("href"), docs_host).alias("slug"))
    lost = linked.where("id IS NULL").select("source", F.col("canonical_url").alias("url"), F.concat(F.lit("no id from the link of card "), "name").alias("message"))
    lost = lost.unionByName(used.where("id IS NULL").select("source", F.col("canonical_url").alias("url"), F.concat(F.lit("no id from the name of card "), "name").alias("message")))
    lost = lost.unionByName(linked.where((F.col("kind") == PRODUCTS_OVERVIEW) & F.col("family").isNull()).select("source", F.col("canonical_url").alias("url"), F.concat(F.lit("no id from the heading "), "group").alias("message")))
    lost = lost.unionByName(own.where(F.col("kind").isin(PRODUCT, SOLUTION) & F.col("id").isNull()).select("source", "url", F.lit("no id from the page's path").alias("message")))
    return Claims(sources, families, products, solutions, use_cases, edges.select("source", "type", "from_id", "to_id"), docs, lost.distinct())
