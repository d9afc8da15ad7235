"""URL filtering by host-suffix and path-prefix rules, all in DataFrame functions.

A URL expands into expressions ``host suffix + path prefix``: one for each number of labels and each path length that
some rule has, so the expansion is bounded by the rules. Expressions meet the rules by an equi-join on the first eight
hex digits of their SHA-256; the full digest then confirms a hit, and the longest rule wins (of equally long ones an
allow rule, then the larger text). URLs that no rule fits are allowed.

Rules of one shape (labels and path length) are grouped by hash prefix, so a page meets each shape in a join that keeps its
row: with up to ``SHAPES`` shapes no page is exploded, shuffled or joined back. With more shapes, all expressions are
exploded, meet the rules in one join, and hits come back to their page by key and URL.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
or the end. Null, or no ``://``: both empty. Rows that share key and URL share a verdict; each keeps a row. Rules are
broadcast if their counted number allows, and joined by hash prefix otherwise. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.tables import BROADCAST_ROWS

#: action, host, path: the rules of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_VERDICT = "allow"
SHAPES = 32


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expand(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The expressions of a URL: array of host suffix + path prefix."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.array_compact(F.array(*(F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels)))
    prefixes = F.array_compact(F.array(*(F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths)))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def expression(host: Column, path: Column, labels: int, length: int) -> Column:
    """The URL's expression of one shape; null if its host or path is shorter."""
    parts = F.split(host, r"\.", -1)
    fits = (F.size(parts) >= labels) & (F.char_length(path) >= length)
    return F.when(fits, F.concat(F.array_join(F.slice(parts, -labels, labels), "."), F.substring(path, 1, length)))


def confirmed(rules: str, digest: Column) -> Column:
    """The largest value of the rules with this digest, null for none."""
    return F.array_max(F.transform(F.filter(rules, lambda r: r["_rule_digest"] == digest), lambda r: r["_value"]))


def by_shape(pages: DataFrame, rules: DataFrame, shapes: list[tuple[int, int]], small: bool) -> DataFrame:
    """_key, host, path, _best (the winning rule's length, whether it allows, rule and action; null without a hit)."""
    found = []
    for k, (labels, length) in enumerate(sorted(shapes)):
        own = rules.where((F.col("_labels") == labels) & (F.col("_length") == length))
        own = own.groupBy(F.col("_short").alias(f"_short{k}")).agg(F.collect_list(F.struct("_rule_digest", "_value")).alias(f"_rules{k}"))
        own = F.broadcast(own) if small else own
        digest = F.sha2(expression(F.col("host"), F.col("path"), labels, length), 256)
        pages = pages.withColumn(f"_digest{k}", digest).withColumn("_s", F.substring(f"_digest{k}", 1, 8)).join(own, F.col("_s") == F.col(f"_short{k}"), "left").drop("_s", f"_short{k}")
        found.append(confirmed(f"_rules{k}", F.col(f"_digest{k}")))
    return pages.select("_key", "host", "path", F.array_max(F.array_compact(F.array(*found))).alias("_best"))


def by_expression(pages: DataFrame, rules: DataFrame, labels: list[int], lengths: list[int], small: bool) -> DataFrame:
    """The same from exploded expressions."""
    rules = rules.select("_short", "_rule_digest", "_value")
    rules = F.broadcast(rules) if small else rules
    asked = pages.where("host <> ''").select("_key", "_url", F.explode(expand(F.col("host"), F.col("path"), labels, lengths)).alias("_expression"))
    asked = asked.withColumn("_digest", F.sha2("_expression", 256)).withColumn("_short", F.substring("_digest", 1, 8)).drop("_expression")
    hits = asked.join(rules, "_short").where("_digest = _rule_digest")
    hits = hits.groupBy("_key", "_url").agg(F.max("_value").alias("_best")).select(F.col("_key").alias("_k"), F.col("_url").alias("_u"), "_best")
    return pages.join(hits, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_url") == F.col("_u")), "left").select("_key", "host", "path", "_best")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """The key with host, path, rule and verdict of each page. ``rules``: action, host, path; empty rules allow all."""
    rules = rules.select("action", F.lower("host").alias("_h"), F.col("path").alias("_p")).withColumn("rule", F.concat("_h", "_p"))
    rules = rules.withColumn("_labels", F.size(F.split("_h", r"\.", -1))).withColumn("_length", F.char_length("_p"))
    shapes = [(r["_labels"], r["_length"]) for r in rules.select("_labels", "_length").distinct().collect()]
    n = rules.count()
    pages = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    pages = pages.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    if not n:
        return pages.select(F.col("_key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT_VERDICT).alias("verdict"))
    value = F.struct(F.char_length("rule").alias("n"), (F.col("action") == "allow").alias("a"), F.col("rule"), F.col("action"))
    rules = rules.withColumn("_rule_digest", F.sha2("rule", 256)).withColumn("_short", F.substring("_rule_digest", 1, 8)).withColumn("_value", value)
    small = n <= BROADCAST_ROWS
    if len(shapes) <= SHAPES:
        judged = by_shape(pages, rules, shapes, small)
    else:
        judged = by_expression(pages, rules, sorted({a for a, _ in shapes}), sorted({b for _, b in shapes}), small)
    return judged.select(F.col("_key").alias(key), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(DEFAULT_VERDICT)).alias("verdict"))
