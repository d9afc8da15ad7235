"""The configuration of sources: its shape, its ranges, and what must hold between its parts. All issues are reported.

config: one row of allowedHosts, fetch and sources (``CONFIG``); issues are code, path, message, phase, ord, sub. Sources may be given as
rows (ord, id, url, pageKind) beside a configuration without them, so that no cell holds them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import id_slug, unique_list, url_host
from cairn.operators.dimensions import PRECEDENCE, host_of_kind
from cairn.operators.integrity import issues, later_rows, report, two_phases

CONFIG = "allowedHosts array<string>, fetch struct<timeoutMs:double,maxRetries:double,concurrency:double,minRequestIntervalMs:double>, sources array<struct<id:string,url:string,pageKind:string>>"
# fixed values: ranges that a configuration may choose from
RANGES = {"timeoutMs": (1000, 30000), "maxRetries": (0, 3), "concurrency": (1, 4), "minRequestIntervalMs": (250, 10000)}
#: https, and nothing behind the path or before the host; the host is checked against the list.
SEED = r"\Ahttps://[^/?#@:\s]+(/[^?#\s]*)?\z"


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFIG).option("multiLine", True).json(path)


def policy(name: str) -> Column:
    """Whether a knob is a whole number in its range."""
    value, (low, high) = F.col(f"fetch.{name}"), RANGES[name]
    return F.coalesce((value == F.floor(value)) & value.between(low, high), F.lit(False))


def seed_url(url: Column) -> Column:
    return F.coalesce(url.rlike(SEED) & (F.length(url) <= 300), F.lit(False))


def coupled(url: Column, kind: Column, docs_host: str, site_host: str) -> Column:
    """Whether a page of this kind may lie on its host."""
    return url_host(url) == host_of_kind(kind, docs_host, site_host)


def entries(config: DataFrame) -> DataFrame:
    return config.select(F.posexplode("sources").alias("ord", "s")).select("ord", "s.*")


def shape_issues(config: DataFrame, approved: list[str], sources: DataFrame | None = None) -> DataFrame:
    listed = entries(config) if sources is None else sources
    some = config.crossJoin(F.broadcast(listed.agg((F.count("*") > 0).alias("_some"))))  # one row
    row = some.withColumn("_ord", F.lit(0))
    one = lambda holds, path, message: issues(row.where(~F.coalesce(holds, F.lit(False))), "invalid-shape", F.lit(path), F.lit(message), F.col("_ord"))
    each = lambda holds, field, message: issues(listed.where(~F.coalesce(holds, F.lit(False))), "invalid-shape", F.concat(F.lit("sources["), F.col("ord").cast("string"), F.lit(f"].{field}")), F.lit(message), F.col("ord"))
    return report([
        one(unique_list(F.col("allowedHosts")), "allowedHosts", "hosts must be unique, one at least"),
        one(F.size(F.array_except("allowedHosts", F.array(*map(F.lit, approved)))) == 0, "allowedHosts", "host is not approved"),
        *(one(policy(name), f"fetch.{name}", f"whole number from {low} to {high}") for name, (low, high) in RANGES.items()),
        one(F.col("_some"), "sources", "one source at least"),
        each(id_slug(F.col("id")), "id", "slug"),
        each(seed_url(F.col("url")), "url", "https URL without query, fragment, port or credentials"),
        each(F.col("pageKind").isin(*PRECEDENCE), "pageKind", "kind of page"),
    ])


def cross_issues(config: DataFrame, docs_host: str, site_host: str, sources: DataFrame | None = None) -> DataFrame:
    """Repeated ids, hosts that aren't allowed, kinds on the wrong host, repeated URLs."""
    rows = (entries(config) if sources is None else sources).withColumn("host", url_host(F.col("url")))
    hosts = config.select(F.explode("allowedHosts").alias("host")).distinct()
    at = lambda field: F.concat(F.lit("sources["), F.col("ord").cast("string"), F.lit(f"].{field}"))
    wanted = host_of_kind(F.col("pageKind"), docs_host, site_host)
    wrong = rows.join(hosts, "host", "left_semi").where(F.col("host") != wanted)
    same = rows.withColumn("_href", F.when(F.col("url").rlike("^https://[^/]+$"), F.concat("url", F.lit("/"))).otherwise(F.col("url")))
    return report([
        issues(later_rows(rows, ["id"]), "duplicate-id", at("id"), F.concat(F.lit("Duplicate source id '"), "id", F.lit("'")), F.col("ord")),
        issues(rows.join(hosts, "host", "left_anti"), "invalid-shape", at("url"), F.concat(F.lit("URL hostname '"), "host", F.lit("' is not listed in allowedHosts")), F.col("ord")),
        issues(wrong, "invalid-shape", at("pageKind"), F.concat(F.lit("pageKind '"), "pageKind", F.lit("' requires hostname '"), wanted, F.lit("'")), F.col("ord")),
        issues(later_rows(same, ["_href"]), "invalid-shape", at("url"), F.concat(F.lit("Duplicate source URL '"), "url", F.lit("'")), F.col("ord")),
    ])


def config_issues(config: DataFrame, approved: list[str], docs_host: str, site_host: str) -> DataFrame:
    return two_phases(shape_issues(config, approved), cross_issues(config, docs_host, site_host))


def load(spark: SparkSession, path: str, approved: list[str], docs_host: str, site_host: str) -> DataFrame:
    """A configuration that holds; raises with a line for each issue, of which none has more of the input than its path."""
    from cairn.operators.integrity import gate

    config = read_config(spark, path)
    gate(config_issues(config, approved, docs_host, site_host), "Source config")
    return config
