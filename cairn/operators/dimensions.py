"""Constant dimensions, as Python values and as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: versions of both documents, kinds of pages and their precedence, types of edges and their end collections,
# lanes and their layers in order, ranks of a node's status
CATALOG_VERSION = CURATED_VERSION = "1"
PRECEDENCE = {"marketing-product": 2, "marketing-solution": 2, "marketing-overview": 1, "developer-docs": 0}
ENDPOINTS = {"product-solution": ("products", "solutions"), "product-use-case": ("products", "useCases"), "solution-use-case": ("solutions", "useCases")}
LANE_LAYERS = {
    "public-web": ["dns-connectivity", "network-l3", "network-l4", "application-security", "application-performance", "compute-platform", "observability"],
    "zero-trust": ["access-control", "data-protection", "network-services"],
}
STATUS_RANK = {"visited": 0, "marked": 1, "verified": 2}
DOCS_KIND = "developer-docs"
SOLUTION_PREFIX = "solution:"


def precedences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRECEDENCE.items()), "page_kind string, precedence int")


def endpoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in ENDPOINTS.items()], "type string, from_collection string, to_collection string")


def layers(spark: SparkSession, lanes: dict[str, list[str]] = LANE_LAYERS) -> DataFrame:
    """lane, layer, ord: a layer's place is counted over all lanes."""
    rows = [(lane, layer) for lane, own in lanes.items() for layer in own]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "lane string, layer string, ord int")


def labels(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """slug, label: display texts of lanes or layers; what has none is shown by its slug."""
    return spark.createDataFrame(list(texts.items()) or [("", "")], "slug string, label string")


def pairs(spark: SparkSession, one_way: list[tuple[str, str]]) -> DataFrame:
    """id, paired: pairs of ids that are mixed up easily, in both directions."""
    return spark.createDataFrame([p for a, b in one_way for p in ((a, b), (b, a))], "id string, paired string")


def status_rank(status: Column) -> Column:
    """The rank of a node's status, null for what is none."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in STATUS_RANK.items() for x in pair)), status)


def solution_key(solution: Column) -> Column:
    """The key of a solution's progress: products and solutions may share ids."""
    return F.concat(F.lit(SOLUTION_PREFIX), solution)


def host_of_kind(kind: Column, docs_host: str, site_host: str) -> Column:
    return F.when(kind == DOCS_KIND, docs_host).otherwise(site_host)
