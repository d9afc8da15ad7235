"""Connected components of a graph in a DataFrame of edges, by contraction.

Each round labels a node with the least of itself and its neighbours, then replaces nodes by labels and drops edges
within a label. The first round goes by id, later ones by a hash of it, so that the number of rounds grows with the
logarithm of the graph, whatever the order of ids along a path. Minima are partially aggregated, and labels are written
before edges join them, so that Spark can split a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of all nodes of ``edges`` (columns a, b) with another neighbour."""
    edges = written(edges.select("a", "b").where("a <> b").distinct())
    levels: list[DataFrame] = []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if levels:
            at = F.least(*(F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id")) for c in ("a", "b")))
            label = both.groupBy("a").agg(F.min(at).alias("m")).select(F.col("a").alias("node"), F.col("m.id").alias("label"))
        else:
            label = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).select(F.col("a").alias("node"), "label")
        label = written(label)
        levels.append(label)
        one = edges.join(label, edges.a == label.node).select(F.col("label").alias("a"), "b")
        two = one.join(label, one.b == label.node).select("a", F.col("label").alias("b"))
        edges = written(two.where("a <> b").distinct())
        if edges.isEmpty():
            break
    found = levels[-1]
    for lower in reversed(levels[:-1]):
        upper = found.select(F.col("node").alias("n"), F.col("label").alias("l"))
        found = written(lower.join(upper, lower.label == upper.n, "left").select("node", F.coalesce("l", "label").alias("label")))
    if len(levels) == 1:
        return found.withColumnRenamed("label", "component")
    least = written(found.groupBy("label").agg(F.min("node").alias("component")))
    return written(found.join(least, "label").select("node", "component"))
