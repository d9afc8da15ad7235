"""Sets of members, and what pairs of sets have in common.

members: solution, id. Of a pair, the set that is in more pairs stays and the other's members travel to it; of these only ids that
some set that stays has, so what travels grows with the pairs' smaller sides and not with all ids that there are. Repeated rows count
once. Pairs are two ways one. Null solutions and ids are in no set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.sources.shared import written

#: Sizes of sets that are large: of a word of bits, and of a block in words.
WORD = 64
WORDS = 64


class Sets:
    """The sets of a table of members, which is read where it lies."""

    def __init__(self, members: DataFrame):
        self.members = members.select("solution", "id").dropna()

    def _own(self, pairs: DataFrame) -> DataFrame:
        same = pairs.where("a = b").select("a", "b").distinct()
        return self.members.withColumnRenamed("solution", "a").join(same, "a").select("a", "b", "id").distinct()

    def _met(self, pairs: DataFrame) -> DataFrame:
        """a < b, id: the common members of each pair of two sets, once."""
        once = written(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        n = once.select(F.explode(F.array("a", "b")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
        turn = F.col("_na") > F.col("_nb")
        sided = once.join(n.toDF("a", "_na"), "a").join(n.toDF("b", "_nb"), "b")
        sided = written(sided.select("a", "b", F.when(turn, F.col("a")).otherwise(F.col("b")).alias("_stays"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("_goes")))
        stay = self.members.join(sided.select(F.col("_stays").alias("solution")).distinct(), "solution", "left_semi").distinct()
        stay = written(stay.toDF("_stays", "id"))
        go = self.members.join(sided.select(F.col("_goes").alias("solution")).distinct(), "solution", "left_semi")
        go = written(go.join(stay.select("id").distinct(), "id", "left_semi").select(F.col("solution").alias("_goes"), "id").distinct())
        return sided.join(go, "_goes").join(stay, ["_stays", "id"]).select("a", "b", "id")

    def counts(self, pairs: DataFrame) -> DataFrame:
        """a, b, n_common of the pairs (a, b) that have a common member, as they are given; a set and itself have all."""
        found = self._met(pairs).groupBy("a", "b").agg(F.count("*").alias("n_common"))
        return both_ways(pairs, found).unionByName(self._own(pairs).groupBy("a", "b").agg(F.count("*").alias("n_common")))

    def ids(self, pairs: DataFrame) -> DataFrame:
        """a, b, id: the common members of each pair, once for both ways (a < b), and all of a set and itself."""
        return self._met(pairs).unionByName(self._own(pairs))


def both_ways(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b), each once, with what was found for theirs (a <= b), as they are given."""
    rest = [c for c in found.columns if c not in ("a", "b")]
    asked = pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return asked.join(found, ["a", "b"]).select(F.col("_a").alias("a"), F.col("_b").alias("b"), *rest)
