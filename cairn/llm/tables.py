"""Reading the tables, joins whose broadcasts are bounded, and filters of bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.sources.shared import shared_dir, written

__all__ = ["BROADCAST_ROWS", "bit_blocks", "filter_bits", "filter_rounds", "hits", "join_groups", "maybe", "narrow", "read", "reduced", "shared_dir", "small_batches", "with_found", "written"]

#: Rows up to which a narrow table may be broadcast, once counted (16 to 64 bytes a row).
BROADCAST_ROWS = 500_000
#: Bits of a filter per row it is made for, and the most bits of any filter: 64 MB, whatever the input.
BITS_PER_ROW, MAX_BITS = 16, 1 << 29
#: Bits of a block, the row of a filter: 512 words of 64.
BLOCK_BITS = 1 << 15


#: Rows of an Arrow batch, where the session leaves Spark's 10,000: texts are long, and each task holds a batch twice.
ARROW_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(ARROW_ROWS))


def with_found(docs: DataFrame, text: str, keep: list[str], found: list[T.StructField], model: Callable) -> DataFrame:
    """The columns in ``keep`` and what a model finds in the text column: ``model()`` is made once a task and maps a batch's
    texts to tuples of the fields ``found``. A text that is kept travels once."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*(docs.schema[c] for c in keep), *found])
    arrow, names = to_arrow_schema(out), [f.name for f in found]
    columns = keep if text in keep else [*keep, text]
    at, n = columns.index(text), len(keep)

    def run(batches):
        find = model()
        for b in batches:
            rows = find([t.as_py() for t in b.column(at)])
            made = [pa.array([r[i] for r in rows], arrow.field(n + i).type) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], schema=arrow)
            pa.default_memory_pool().release_unused()

    return docs.select(*columns).mapInArrow(run, out)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """rows joined with the row of their group. Groups of more than a thousandth of ``n`` rows are a thousand at most and
    join by broadcast; the others have a bounded number of rows each. ``groups`` should be a written table."""
    large = max(1000, n // 1000)
    hot = groups.where(F.col(size) > large)
    tagged = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    one = tagged.where("_hot").drop("_hot").join(F.broadcast(hot), key)
    return one.unionByName(tagged.where("_hot IS NULL").drop("_hot").join(groups.where(F.col(size) <= large), key))


def narrow(rows: DataFrame) -> DataFrame:
    """rows with a broadcast hint if their count allows it; a written table of a few columns."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


# filters ------------------------------------------------------------------------------------------------------------
def filter_bits(n: int) -> int:
    """Bits of a filter for n rows, a power of two."""
    return min(MAX_BITS, max(BLOCK_BITS, 1 << (BITS_PER_ROW * n).bit_length()))


def bit_blocks(hashes: DataFrame, name: str, bits: int, least: int = 1) -> DataFrame:
    """The filter of the bits that ``least`` or more rows hit: block, words (an array of longs). At most bits / BLOCK_BITS
    rows of 4 kB. What is shuffled to make it is bit numbers, counted on the map side first: a task holds a small share of
    the rows, so its list of bits is shorter than its bitmap."""
    bit = F.pmod(F.col(name), F.lit(bits))
    hit = hashes.groupBy(bit.alias("_bit")).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    words = hit.groupBy(F.expr(f"cast(_bit div {BLOCK_BITS} as int)").alias("_block"), F.expr(f"cast(_bit div 64 % {BLOCK_BITS // 64} as int)").alias("_word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_mask"))
    blocks = words.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_mask"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(0).cast("long")))
    return blocks.select("_block", dense.alias("_words"))


def hits(rows: DataFrame, name: str, blocks: DataFrame, bits: int, out: str) -> DataFrame:
    """rows with ``out``: whether the filter has the bit of the hash in column ``name``. The filter is broadcast."""
    bit = F.pmod(F.col(name), F.lit(bits))
    rows = rows.withColumn("_block", (bit / F.lit(BLOCK_BITS)).cast("int")).join(F.broadcast(blocks), "_block", "left")
    word = F.get("_words", (bit % F.lit(BLOCK_BITS) / F.lit(64)).cast("int"))
    shifted: Column = F.call_function("shiftright", word, (bit % 64).cast("int"))
    return rows.withColumn(out, F.coalesce(shifted.bitwiseAND(F.lit(1)) == 1, F.lit(False))).drop("_block", "_words")


def reduced(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that may have a partner in ``keys``, a written table: all those that have one, and few others. Rows that
    a join with many keys would shuffle in vain are left out where they are read."""
    n = keys.count()
    if n <= BROADCAST_ROWS:
        return rows
    bits, h = filter_bits(n), F.xxhash64(*on)
    blocks = written(bit_blocks(keys.select(h.alias("_h")), "_h", bits))
    return hits(rows.withColumn("_h", h), "_h", blocks, bits, "_maybe").where("_maybe").drop("_h", "_maybe")


def filter_rounds(spark: SparkSession, hashes: DataFrame, name: str) -> Iterator[tuple[int, int, Broadcast]]:
    """Filters of the distinct hashes in column ``name`` (a written table) for tasks in Python: (round, rounds, bytes of the
    bits). A round's filter holds the hashes whose bits 40 and up are the round modulo ``rounds``; there are as many rounds as
    keep a filter within MAX_BITS at BITS_PER_ROW a hash, so its size is bounded and it never fills up. Each is let go after
    its round; what was made with it should be written by then."""
    n = hashes.count()
    rounds = max(1, -(-n * BITS_PER_ROW // MAX_BITS))
    for k in range(rounds):
        own = hashes.where(F.pmod(F.shiftright(name, 40), F.lit(rounds)) == k) if rounds > 1 else hashes
        bits = filter_bits(-(-n // rounds))
        words = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 64), np.int64)
        for b in bit_blocks(own, name, bits).toArrow().to_batches():
            words[b["_block"].to_numpy()] = b["_words"].flatten().to_numpy().reshape(b.num_rows, -1)
        sent = spark.sparkContext.broadcast(words.tobytes())
        yield k, rounds, sent
        sent.destroy()


def maybe(filter_bytes: bytes, k: int, rounds: int, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) the filter of a round may hold: all that it holds, and few others."""
    words = np.frombuffer(filter_bytes, np.uint64)
    bit = hashes & np.uint64(len(words) * 64 - 1)
    found = (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return found & (np.mod(hashes.view(np.int64) >> 40, rounds) == k) if rounds > 1 else found
