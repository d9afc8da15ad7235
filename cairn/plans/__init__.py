"""The registered queries over the tables, and their SQL. Modules register theirs when they are imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from cairn.plans import catalog_queries, crawl_queries, document_queries, learning_queries, registry, sql_queries, stream_queries  # noqa: F401

    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    from cairn.plans import registry

    return {name: registry.SQL[name] for name in queries() if name in registry.SQL}
