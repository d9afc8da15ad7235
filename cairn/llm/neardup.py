"""Near-duplicate detection with HyperMinHash sketches, verified on full shingle sets.

1. A text's set holds the 64-bit hashes of its distinct shingles of five words. A sketch splits the hashes over
   ``BUCKETS`` by their top bits and keeps, of the smallest hash in each, the number of leading zeros and
   ``MANTISSA_BITS`` of what follows. Empty buckets borrow a filled one by a fixed permutation, so short texts band too.
2. Texts with equal sets form a class; its smallest id stands for it. Copies go no further.
3. Bands of ``BAND`` registers are hashed; classes that share a band are candidates. Two sets of similarity 0.75 miss
   each other in all 51 bands once in a million.
4. A shared band is not expanded into pairs. In the first few bands, members meet one pivot; this joins most of what
   belongs together, and after it only bands that hold several components count. There, members outside the largest
   component meet a few of its members; only what is still in another component after that is compared with all of the
   band, block by block on full sets.
5. Pairs whose sizes allow the threshold and whose collision-corrected estimate is within ``ERRORS`` standard errors of it
   are verified on their full sets, computed again from the whole texts of the documents concerned.

Texts with fewer than five words have one shingle, the whole sequence; without words, none and no links. Null texts are
empty. doc_ids may be of any type that has an order. Rows that share a doc_id and differ in text are documents of their
own: each is in the component of its text, which is named by its smallest doc_id. A null doc_id links with nothing and
keeps its row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.components import components
from cairn.llm.tables import join_groups, narrow, reduced, written

WORDS = 5
#: The threshold as a fraction: similar if DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 75, 100
BUCKETS, MANTISSA_BITS, BAND = 256, 10, 5
BANDS = BUCKETS // BAND
#: Standard errors by which an estimate may miss the threshold.
ERRORS = 5.2
#: Bands in which members meet a pivot before components count.
FIRST_BANDS = 12
#: Members of a band's largest component that its other members meet before any wider comparison.
PIVOTS = 8
#: Sets on either side of a block comparison.
BLOCK = 256

_BOUNDS = (np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56))
_BORROW = np.stack([np.random.default_rng(7_000 + k).permutation(BUCKETS) for k in range(BUCKETS)])
_ODD = np.random.default_rng(11).integers(1 << 62, 1 << 63, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. Lower-casing and splitting bytes touches ASCII only."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    total = h[:n] * _ODD[0]
    for k in range(1, WORDS):
        total = total + h[k : k + n] * _ODD[k]
        total = total ^ (total >> np.uint64(29))
    return np.unique(_mix(total))


def registers(values: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty sorted set: BUCKETS numbers of 16 bits."""
    starts = np.searchsorted(values, _BOUNDS)
    filled = starts < np.append(starts[1:], len(values))
    rest = values[np.minimum(starts, len(values) - 1)] << np.uint64(8)
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 56).astype(np.uint64)
    mantissa = (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA_BITS)
    out = (zeros << np.uint64(MANTISSA_BITS)) | mantissa
    empty = np.flatnonzero(~filled)
    if len(empty):
        borrow = _BORROW[empty]
        out[empty] = out[borrow[np.arange(len(empty)), filled[borrow].argmax(axis=1)]]
    return out.astype(np.uint16)


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that a register of two disjoint sets of n and m elements is equal: both minima in one level of
    leading zeros, and equal mantissas."""
    level = np.arange(0, 48, dtype=np.float64)

    def at(k):
        per = np.maximum(np.asarray(k, np.float64)[:, None] / BUCKETS, 1.0)
        over = 1 - (1 - 2.0 ** -level[None, :]) ** per
        return np.diff(-np.concatenate([over, np.zeros((len(per), 1))], axis=1), axis=1)

    return (at(n) * at(m)).sum(axis=1) * 2.0**-MANTISSA_BITS


def least_estimate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least estimate at which two sets of n and m elements are verified. The standard error is that of the registers
    which the larger set fills; short texts fill few."""
    share = NUMERATOR / DENOMINATOR
    filled = BUCKETS * -np.expm1(-np.maximum(np.maximum(n, m), 1) / BUCKETS)
    return share - ERRORS * np.sqrt(share * (1 - share) / np.maximum(filled, 1))


SKETCH = [T.StructField("n_shingles", T.LongType()), T.StructField("fingerprint", T.BinaryType()), T.StructField("registers", T.BinaryType())]
PAIR = "a long, b long"


def fingerprint(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``carry``, n_shingles, fingerprint (of the set) and registers; the last two null for empty
    sets."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([docs.schema["doc_id"], *(docs.schema[c] for c in carry), *SKETCH])
    arrow = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(0):
                s = shingle_set(text.as_py())
                rows.append((len(s), fingerprint(s), registers(s).tobytes()) if len(s) else (0, None, None))
            cols = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(arrow)[1 + len(carry) :])]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], schema=arrow)

    return docs.select("text", "doc_id", *carry).mapInArrow(run, out)


def banded(classes: DataFrame, first: int, last: int) -> DataFrame:
    """classes with a row for each of their bands [first, last): ``band``, a hash of its registers and its number."""
    key = lambda k: F.xxhash64(F.substring("registers", k * (2 * BAND) + 1, F.lit(2 * BAND)), k)
    return classes.withColumn("band", F.explode(F.transform(F.sequence(F.lit(first), F.lit(last - 1)), key))).drop("registers")


def sided(pairs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """a, b, and the column ``name`` of both ends as a_<name>, b_<name>. rows: node and the column. The b end meets its
    pairs where it is read, then only the ends that some pair has are shuffled, by a."""
    some = reduced(rows, pairs.select(F.col("b").alias("node")), ["node"])
    two = some.join(narrow(pairs), some.node == pairs.b).select("a", "b", F.col(name).alias(f"b_{name}"))
    ends = written(pairs.select(F.col("a").alias("node")).distinct())
    one = reduced(rows, ends, ["node"]).join(narrow(ends), "node").select(F.col("node").alias("a"), F.col(name).alias(f"a_{name}"))
    return two.join(one, "a").select("a", "b", f"a_{name}", f"b_{name}")


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs a, b whose sizes and collision-corrected similarity estimate allow the threshold."""
    joined = sided(pairs, classes.select("node", F.struct("n", "registers").alias("s")), "s")
    sizes = "a_s.n", "b_s.n"
    joined = joined.where(F.least(*sizes) * DENOMINATOR >= F.greatest(*sizes) * NUMERATOR).select("a", "b", *sizes, "a_s.registers", "b_s.registers").toDF("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in (4, 5))
            sizes = b.column(2).to_numpy(), b.column(3).to_numpy()
            chance = collision_rate(*sizes)
            estimate = ((one == two).mean(axis=1) - chance) / (1 - chance)
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(estimate >= least_estimate(*sizes)))

    return joined.mapInArrow(run, PAIR)


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and values (the packed shingle set) of ``nodes``, from the whole text of a document of each class. A row of
    another text with that doc_id is known by its fingerprint and left out."""
    wanted = written(classes.select("node", "doc_id", "fingerprint").join(narrow(nodes), "node").select("node", "doc_id", "fingerprint"))
    texts = reduced(docs.select("doc_id", "text"), wanted.select("doc_id"), ["doc_id"]).join(narrow(wanted), "doc_id").select("node", "fingerprint", "text")

    def run(batches):
        for b in batches:
            found = []
            for node, known, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = shingle_set(text.as_py())
                if len(s) and fingerprint(s) == known:
                    found.append((node, s.tobytes()))
            yield pa.record_batch([pa.array([n for n, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary())], names=["node", "values"])

    return written(texts.mapInArrow(run, "node long, values binary"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs a, b whose full shingle sets are similar. A row that repeats a document repeats its links, no more."""
    nodes = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    joined = sided(pairs, full_sets(nodes, classes, docs), "values")

    def run(batches):
        for b in batches:
            keep = []
            for one, two in zip(b.column(2), b.column(3), strict=True):
                one, two = (np.frombuffer(x.as_py(), np.uint64) for x in (one, two))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(DENOMINATOR * both >= NUMERATOR * (len(one) + len(two) - both))
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, PAIR)


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links a, b between classes (node, doc_id, fingerprint, n, registers): all that matter for components."""
    tested = lambda pairs: written(verified(written(estimated(written(pairs.distinct()), classes)), classes, docs))
    # in the first few bands, members meet the band's first one: this joins most of what belongs together
    members = banded(classes.select("node", "registers"), 0, FIRST_BANDS)
    shared = written(members.groupBy("band").agg(F.count("*").alias("_n"), F.min("node").alias("pivot")).where("_n > 1").drop("_n"))
    found = tested(members.join(narrow(shared), "band").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    # then, in all bands that hold several components, members outside the largest meet a few of it, one for each of PIVOTS hashes
    rest = unsettled(banded(parts(classes.select("node", "registers"), components(found)), 0, BANDS))
    chosen = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("p")))["p"] for k in range(PIVOTS)]
    pivots = rest.where("component = core").groupBy("band").agg(F.array_distinct(F.array(*chosen)).alias("pivots"))
    some = rest.where("component <> core").join(narrow(written(pivots)), "band").select("node", F.explode("pivots").alias("x"))
    found = written(found.unionByName(tested(some.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")))))
    # and what is left of them all members of other components: after this every shared band is settled
    rest = unsettled(parts(rest.select("node", "band"), components(found)))
    return found.unionByName(settled(rest, classes, docs))


def intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each set of ``one`` with each of ``two``: a product of incidence matrices, over the
    values that occur on both sides, a few thousand at a time."""
    values, place = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    cut = sum(map(len, one))
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two)]
    columns = [place[:cut], place[cut:]]
    both = np.flatnonzero(np.bincount(columns[0], minlength=len(values)).astype(bool) & np.bincount(columns[1], minlength=len(values)).astype(bool))
    at = np.full(len(values), -1)
    at[both] = np.arange(len(both))
    out = np.zeros((len(one), len(two)), np.float32)
    for start in range(0, len(both), 4096):
        parts = []
        for r, c, sets in zip(rows, columns, (one, two), strict=True):
            here = (at[c] >= start) & (at[c] < start + 4096)
            m = np.zeros((len(sets), min(4096, len(both) - start)), np.float32)
            m[r[here], at[c[here]] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def folded(regs: np.ndarray) -> np.ndarray:
    """Registers of one byte: as good for telling sets apart that are far from similar, at half the bytes."""
    return ((regs.astype(np.uint32) * np.uint32(0x9E37)) >> np.uint32(8)).astype(np.uint8)


def candidates(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``asked`` whose node has, in its group of two blocks, a partner in another component that the folded
    registers allow. No pair is a row."""
    nodes = written(asked.select("node").distinct())
    own = classes.select("node", "n", "registers").join(narrow(nodes), "node").select("node", "n", "registers")

    def fold(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([folded(np.frombuffer(x.as_py(), np.uint16)).tobytes() for x in b.column(2)], pa.binary())], names=["node", "n", "f"])

    names = asked.columns
    rows = asked.join(written(own.mapInArrow(fold, "node long, n long, f binary")), "node").select(*names, "n", "f")

    def run(table: pa.Table) -> pa.Table:
        side = table.column("asks").to_numpy(zero_copy_only=False)
        keep = np.zeros(len(side), bool)
        if side.any() and not side.all():
            part, n = (table.column(c).to_numpy() for c in ("component", "n"))
            regs = np.frombuffer(b"".join(table.column("f").to_pylist()), np.uint8).reshape(-1, BUCKETS)
            x, y = np.flatnonzero(side), np.flatnonzero(~side)
            for i in x:
                chance = collision_rate(n[i : i + 1], n[y])
                chance = chance + (1 - chance) / 256
                close = (regs[y] == regs[i]).mean(axis=1) >= chance + least_estimate(n[i : i + 1], n[y]) * (1 - chance)
                near = y[close & (part[y] != part[i]) & (np.minimum(n[y], n[i]) * DENOMINATOR >= np.maximum(n[y], n[i]) * NUMERATOR)]
                keep[near] = True
                keep[i] = len(near) > 0
        return table.select(names).filter(pa.array(keep))

    return rows.groupBy("band", "q", "m").applyInArrow(run, asked.schema)


def settled(rest: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links a, b between different components within a band, one for each two components that a block meets. Members
    outside the band's core are queries against all of the band, in blocks of ``BLOCK`` by ``BLOCK``: a group is two
    blocks, and no pair is ever a row. Members that no other could be similar to by their registers leave first; the full
    sets of the others decide."""
    sizes = rest.groupBy("band").agg(F.count_if(F.expr("component <> core")).alias("q"), F.count("*").alias("m"))
    sizes = sizes.select("band", F.ceil(F.col("q") / BLOCK).cast("int").alias("nq"), F.ceil(F.col("m") / BLOCK).cast("int").alias("nm"))
    rest = rest.join(narrow(written(sizes)), "band")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asked = rest.where("component <> core").select("band", "node", "component", F.lit(True).alias("asks"), block("nq").alias("q"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("m"))
    asked = asked.unionByName(rest.select("band", "node", "component", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"), block("nm").alias("m")))
    asked = written(candidates(written(asked), classes))
    rows = asked.join(full_sets(written(asked.select("node").distinct()), classes, docs), "node")

    def run(table: pa.Table) -> pa.Table:
        side = table.column("asks").to_numpy(zero_copy_only=False)
        out: dict[tuple, tuple] = {}
        if side.any() and not side.all():
            ids, part = (table.column(c).to_numpy() for c in ("node", "component"))
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("values")]
            x, y = np.flatnonzero(side), np.flatnonzero(~side)
            both = intersections([sets[k] for k in x], [sets[k] for k in y])
            n = np.array([len(s) for s in sets])
            near = DENOMINATOR * both >= NUMERATOR * (n[x][:, None] + n[y][None, :] - both)
            for i, j in np.argwhere(near & (part[x][:, None] != part[y][None, :])):
                out.setdefault((part[x[i]], part[y[j]]), (ids[x[i]], ids[y[j]]))
        return pa.table({"a": pa.array([a for a, _ in out.values()], pa.int64()), "b": pa.array([b for _, b in out.values()], pa.int64())})

    return rows.groupBy("band", "q", "m").applyInArrow(run, PAIR)


def parts(rows: DataFrame, part: DataFrame) -> DataFrame:
    """rows with the component of their node: itself where nothing links it."""
    part = written(part.withColumnRenamed("node", "_node"))
    return rows.join(narrow(part), F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "node")).drop("_node")


def unsettled(rows: DataFrame) -> DataFrame:
    """band, node, component and core (the band's largest component) of the bands that hold more than one component. Bands
    are aggregated first, so members of all others meet nothing."""
    mixed = rows.groupBy("band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("band")
    rest = written(rows.select("band", "node", "component").join(narrow(written(mixed)), "band"))
    sizes = rest.groupBy("band", "component").agg(F.count("*").alias("_n"))
    core = written(sizes.groupBy("band").agg(F.max(F.struct("_n", "component")).alias("_m")).select("band", F.col("_m.component").alias("core")))
    return written(rest.join(narrow(core), "band"))


def near_groups(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of ``docs`` (doc_id, text; other columns are ignored). With
    ``carry``, also these columns and ``first`` (the component's least row of doc_id and them; null for rows without links)."""
    own = ("doc_id", *carry)
    docs = docs.select(*own, "text")
    sketched = written(sketches(docs, carry))
    n = sketched.count()
    rows = sketched.drop("registers")
    filled = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("fingerprint").agg(F.min(F.struct(*own)).alias("first"), F.count("*").alias("size"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "first.doc_id", "first", "fingerprint", "size", "n", "registers"))
    part = written(components(links(classes.select("node", "doc_id", "fingerprint", "n", "registers"), docs)))
    linked = part.join(classes.select("node", "fingerprint", "size", "first"), "node")
    least = linked.groupBy("component").agg(F.min("first").alias("first"))
    groups = written(linked.drop("first").join(least, "component").select("fingerprint", "size", "first"))
    groups = groups.unionByName(classes.join(narrow(part.select("node")), "node", "left_anti").select("fingerprint", "size", "first"))
    lone = "n_shingles = 0 OR doc_id IS NULL"
    met = join_groups(rows.where(f"NOT ({lone})"), written(groups), "fingerprint", "size", n).withColumn("component_id", F.col("first.doc_id"))
    met = met.unionByName(rows.where(lone).withColumn("component_id", F.col("doc_id")), allowMissingColumns=True)
    out = met.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select(*own, "n_shingles", "component_id", "kept", *(["first"] if carry else []))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, whole, of which one of each group of near-duplicates stays: the first by doc_id, then by a hash of
    its text; of rows that repeat doc_id and text, one. Rows without words and rows without doc_id all stay."""
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_t"))
    found = near_groups(keyed, ("_t",))
    stays = F.struct("doc_id", "_t") == F.col("first")
    found = written(found.select("doc_id", "_t", F.coalesce(stays, F.lit(True)).alias("_stays"), F.col("first").isNotNull().alias("_linked")))
    goes = written(found.where("NOT _stays").select("doc_id", "_t").distinct())
    twice = written(found.where("_stays AND _linked").groupBy("doc_id", "_t").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    on = ["doc_id", "_t"]
    out = keyed.select("_row", *on).join(narrow(goes), on, "left_anti")
    if not twice.isEmpty():
        again = out.join(narrow(twice), on, "left_semi").dropDuplicates(on)
        out = out.join(narrow(twice), on, "left_anti").unionByName(again)
    return out.select("_row.*")
