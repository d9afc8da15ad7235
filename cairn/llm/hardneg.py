"""Hard-negative mining: exact integer scores by matrix products modulo small primes, then windows of scores.

Rows have a vector of integer components and a label. A score is the inner product of two rows. For each anchor, its positives
are its first rows of the same label; for each of them, its negatives are the first rows of other labels whose score lies
between ``low`` and ``high`` per cent of the positive's. Higher scores come first, ties by smaller id.

Scores come from a residue number system: components modulo a few small primes, balanced about zero, are multiplied as
float32 matrices. A prime is so small that the sum over a run of dimensions stays within 2^24, which float32 holds exactly. Chinese
remaindering gives back the signed score from balanced mixed-radix digits. There are as many primes as the largest possible score
(the largest squared length of a row, measured first) asks for.

The anchors are a stated query set and meet all rows in blocks: rows and anchors are dealt into blocks by a hash of a row
number, a cell is a block of each, and a row or anchor goes once to each cell of its block. Positives meet within a label
only, whose number of blocks follows its size, so that a hot label is many cells. A cell gives at most a few rows for each
of its anchors; the first of these over all cells are found by windows that keep a few rows per task.

Rows with a null label, a null vector or a null or non-finite component take no part. An empty vector scores 0, of vectors
of different lengths the shorter one counts as followed by zeros. Rows with a null id may be found, after those with one.
Repeated rows are rows of their own: the copy of an anchor is its positive. An anchor without positives, or whose positives
have no row in their window, gives no rows. Scores that could pass 62 bits raise ValueError before any is computed. An
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.tables import join_groups, written

#: Most and least rows of a block; between them there are three blocks for each core.
BLOCK, LEAST = 16_384, 1_024
#: Scores that a cell computes at a time.
TILE = 1 << 19
#: Integers that float32 holds, and the dimensions summed in one product at most.
EXACT, DIMENSIONS = 1 << 24, 256


def valid(label: Column, vector: Column) -> Column:
    x = vector.cast("array<double>")
    return label.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def primes_for(bound: int, dimensions: int) -> list[int]:
    """Primes whose product passes 2 * bound, the largest that a product over so many dimensions allows."""
    p = 2 * int((EXACT / max(1, min(dimensions, DIMENSIONS))) ** 0.5) + 1
    p, found, product = min(p, 2039), [], 1
    while product <= 2 * bound + 1 or not found:
        while any(p % q == 0 for q in range(2, int(p**0.5) + 1)):
            p -= 1
        found.append(p)
        product *= p
        p -= 1
    return found


def balanced(z: np.ndarray, p: int) -> np.ndarray:
    """z modulo p, from -(p-1)/2 to (p-1)/2, in place; z holds integers up to 2^24 as float32."""
    for _ in range(2):  # the quotient may be rounded to the wrong side once
        q = z * np.float32(1 / p)
        np.rint(q, out=q)
        q *= np.float32(p)
        z -= q
    return z


class Residues:
    """Component matrices of rows modulo each prime, and exact products of them."""

    def __init__(self, primes: list[int]):
        self.primes = primes
        self.wide = int(np.prod(np.array(primes, object))) >= 1 << 53

    def of(self, rows: np.ndarray) -> list[np.ndarray]:
        out = []
        for p in self.primes:
            r = rows % p
            out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
        return out

    def product(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """a @ b.T of the integer matrices, as int64."""
        digits: list[np.ndarray] = []
        for k, p in enumerate(self.primes):
            x, y = a[k], b[k]
            r = np.zeros((len(x), len(y)), np.float32)
            for at in range(0, x.shape[1], DIMENSIONS):
                r = balanced(r + balanced(x[:, at : at + DIMENSIONS] @ y[:, at : at + DIMENSIONS].T, p), p) if at else balanced(x[:, :DIMENSIONS] @ y[:, :DIMENSIONS].T, p)
            radix = 1
            for q, d in zip(self.primes, digits, strict=False):  # what the digits so far amount to, modulo p
                r -= d * np.float32(((radix % p) + p // 2) % p - p // 2)
                radix *= q
            if digits:
                inverse = pow(radix, -1, p)
                r = balanced(balanced(r, p) * np.float32(inverse - p if inverse > p // 2 else inverse), p)
            digits.append(r)
        total, radix = digits[0].astype(np.int64 if self.wide else np.float64), 1
        for q, d in zip(self.primes, digits[1:], strict=False):
            radix *= q
            total += d.astype(total.dtype) * radix
        return total if self.wide else total.astype(np.int64)


def matrix(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """A row of int64 for each list, filled up with zeros."""
    c = column.combine_chunks()
    c = c if isinstance(c, pa.Array) else c.chunk(0)
    values, lengths = c.flatten().to_numpy().astype(np.int64), c.value_lengths().to_numpy()
    if (lengths == dimensions).all():
        return values.reshape(len(lengths), dimensions)
    out = np.zeros((len(lengths), dimensions), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _dealt(count: Column, block: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / block)).cast("int")


def _block(count: Column, block: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("_key", F.lit(salt)), _dealt(count, block)).cast("int")


def _each(count: Column, block: int) -> Column:
    return F.explode(F.sequence(F.lit(0), _dealt(count, block) - 1))


def _ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _tiles(anchors: int, rows: int):
    step = max(1, TILE // max(1, rows))
    return (slice(at, at + step) for at in range(0, anchors, step))


def _first(scores: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Of the places ``at``, those of the ``most`` largest scores, earlier ones first; places are in order of id."""
    if len(at) > most:
        least = np.partition(scores[at], len(at) - most)[len(at) - most]
        above, tied = at[scores[at] > least], at[scores[at] == least]
        return np.concatenate([above, tied[: most - len(above)]])
    return at


def mine(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "vector", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``vector`` is an array of integers; ``anchor``
    says which rows are anchors. Ids are integers; 0 <= low <= high <= 100."""
    spark = rows.sparkSession
    own = rows.select(F.col(vec_id).cast("long").alias("_id"), F.col(label).alias("_label"), F.col(vector).cast("array<long>").alias("_v"), F.coalesce(anchor, F.lit(False)).alias("_anchor"))
    own = written(own.where("_label IS NOT NULL AND forall(_v, x -> x IS NOT NULL)").withColumn("_key", F.monotonically_increasing_id()))
    squared = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, bound, dimensions, peak = own.agg(F.count("*"), F.max(squared), F.max(F.size("_v")), F.max(F.array_max(F.transform("_v", lambda x: F.abs(x.cast("double")))))).first()
    if bound and bound >= 2.0**61:
        raise ValueError(f"scores of {vector} may pass 62 bits")
    primes = primes_for(int((bound or 0) * 1.001) + 1, dimensions or 0)
    small = own.withColumn("_v", F.col("_v").cast("array<smallint>" if (peak or 0) < 1 << 15 else "array<long>"))
    block = max(LEAST, min(BLOCK, n // (3 * spark.sparkContext.defaultParallelism)))

    def positives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("_id", "ascending"), ("_key", "ascending")])
        key, id_, akey = left["_key"].to_numpy(), left["_id"], right["_key"].to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(key) and len(akey):
            system = Residues(primes)
            x, y = system.of(matrix(right["_v"], dimensions)), system.of(matrix(left["_v"], dimensions))
            for tile in _tiles(len(akey), len(key)):
                for a, scores in zip(akey[tile], system.product([m[tile] for m in x], y), strict=True):
                    at = _first(scores, np.flatnonzero(key != a), positives)
                    found.append((np.full(len(at), a), at, scores[at]))
        a, at, score = map(np.concatenate, zip(*found, strict=True))
        return pa.table({"akey": a, "key": key[at], "id": id_.take(pa.array(at)), "score": score})

    sizes = written(own.groupBy("_label").agg(F.count("*").alias("_n"), F.count_if("_anchor").alias("_m")).where("_m > 0"))
    sized = join_groups(small, sizes, "_label", "_n", n)
    left = sized.select("_label", _block(F.col("_n"), block, 1).alias("_r"), _each(F.col("_m"), block).alias("_a"), "_key", "_id", "_v")
    right = sized.where("_anchor").select("_label", _each(F.col("_n"), block).alias("_r"), _block(F.col("_m"), block, 2).alias("_a"), "_key", "_v")
    right = right.toDF(*right.columns)
    cell = ["_label", "_r", "_a"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(positives_of, "akey long, key long, id long, score long")
    positive = written(_ranked(found, ["akey"], positives).withColumnsRenamed({"rank": "place", "id": "positive_id", "score": "positive_score"}))

    def negatives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("_id", "ascending"), ("_key", "ascending")])
        key, id_, akey = left["_key"].to_numpy(), left["_id"], right["_key"].to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(key) and len(akey):
            labels = pa.chunked_array([*left["_label"].chunks, *right["_label"].chunks]).dictionary_encode().unify_dictionaries()
            number = np.concatenate([c.indices.to_numpy() for c in labels.chunks])
            own_label, other_label = number[len(key) :], number[: len(key)]
            system, marks = Residues(primes), right["_scores"].to_pylist()
            x, y = system.of(matrix(right["_v"], dimensions)), system.of(matrix(left["_v"], dimensions))
            for tile in _tiles(len(akey), len(key)):
                for i, scores in enumerate(system.product([m[tile] for m in x], y), tile.start):
                    windows = [(m["place"], -(-low * m["positive_score"] // 100), high * m["positive_score"] // 100) for m in marks[i]]
                    other = np.flatnonzero((scores >= min(w[1] for w in windows)) & (scores <= max(w[2] for w in windows)))
                    other = other[other_label[other] != own_label[i]]
                    s = scores[other]
                    for place, least, most in windows:
                        at = _first(scores, other[(s >= least) & (s <= most)], negatives)
                        found.append((np.full(len(at), akey[i]), np.full(len(at), place, np.int32), at, scores[at]))
        a, place, at, score = map(np.concatenate, zip(*found, strict=True))
        return pa.table({"akey": a, "place": place, "key": key[at], "id": id_.take(pa.array(at)), "score": score})

    marks = positive.where("positive_score >= 0").groupBy("akey").agg(F.collect_list(F.struct("place", "positive_score")).alias("_scores"))
    anchors = written(small.where("_anchor").join(marks, F.col("_key") == F.col("akey")).select("_key", "_id", "_label", "_v", "_scores"))
    m = anchors.count()
    left = small.select(_block(F.lit(n), block, 1).alias("_r"), _each(F.lit(m), block).alias("_a"), "_key", "_id", "_label", "_v")
    right = anchors.select(_each(F.lit(n), block).alias("_r"), _block(F.lit(m), block, 2).alias("_a"), "_key", "_label", "_v", "_scores")
    found = left.groupBy("_r", "_a").cogroup(right.groupBy("_r", "_a")).applyInArrow(negatives_of, "akey long, place int, key long, id long, score long")
    negative = _ranked(found, ["akey", "place"], negatives).select("akey", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("_key").alias("akey"), F.col("_id").alias("anchor_id"))
    return negative.join(positive.drop("key"), ["akey", "place"]).join(ids, "akey").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
