"""Best-fit packing of tokenized documents into sequences, planned over a histogram of lengths.

1. Documents become pieces of at most ``capacity`` tokens; only longer documents are cut, and only a first piece may be
   shorter than ``capacity``.
2. The number of pieces of each length is counted: at most ``capacity`` rows, whatever the input.
3. ``plan_slots`` runs best-fit decreasing over these counts. Sequences with the same free space form ranges of ids, so
   a plan is a list of ranges of slots for each length; documents take no part in it.
4. A piece's rank among those of its length picks its slot. Ranks come from counts of (length, bucket) and a row number
   within the bucket, so no task sees all pieces of a common length.

Null and empty texts are one piece of the end token. Repeated rows are packed each on their own. An empty table gives no
rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import bpe
from cairn.llm.tables import written

CAPACITY = 1024
END_ID = 2
#: Slots of one sequence range: piece rank r in [rank_from, rank_to) takes sequence sequence_from + (r - rank_from) div
#: copies, at offset + ((r - rank_from) mod copies) * length.
PLAN_SCHEMA = "length long, rank_from long, rank_to long, sequence_from long, copies long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kt = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kt), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    arrow, end = to_arrow_schema(out), struct.pack("<I", end_id)

    def pieces(batches):
        c = bpe.codec(tokenizer_path)
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = memoryview(c.encode(text.as_py()) + end)
                rows += [(key, n, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])) for n, (at, size) in enumerate(cut(len(ids) // 4, capacity))]
            yield bpe._finish(rows, arrow)

    return docs.select("doc_id", "text").mapInArrow(pieces, out)


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths: rows of PLAN_SCHEMA. Time and size depend on ``capacity``, not on
    the counts."""
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> ranges (first sequence, number of sequences)
    spaces: list[int] = []
    plan, sequences = [], 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            copies = space // length
            full = min(n, left // copies)
            if full:
                plan.append((length, rank, rank + full * copies, first, copies, capacity - space))
                rank, left = rank + full * copies, left - full * copies
                put(space - copies * length, first, full)
            if full < n and left:  # the last sequence takes the rest
                plan.append((length, rank, rank + left, first + full, left, capacity - space))
                put(space - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(space, first + full, n - full)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` is read three times; pass a written table."""
    spark = pieces.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(plan_slots(histogram, capacity), PLAN_SCHEMA)
    # ranks of a bucket's first piece, from the counts; a window here has one row per bucket
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"), "n")
    # the planned slots that a bucket's pieces reach, in order of rank: few per bucket
    slots = before.join(F.broadcast(plan), "length").where("rank_from < _before + n AND rank_to > _before")
    slots = slots.groupBy("length", "_bucket").agg(F.first("_before").alias("_before"), F.sort_array(F.collect_list(F.struct("rank_from", "rank_to", "sequence_from", "copies", "offset"))).alias("_slots"))
    number = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = pieces.withColumn("_in", number - 1).join(slots, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_in"))
    slot = F.filter("_slots", lambda s: (s["rank_from"] <= F.col("_rank")) & (F.col("_rank") < s["rank_to"]))[0]
    ranked = ranked.withColumn("_slot", slot).withColumn("_in", F.col("_rank") - F.col("_slot.rank_from"))
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_slot.sequence_from") + F.floor(F.col("_in") / F.col("_slot.copies"))).cast("long").alias("sequence_id"),
        (F.col("_slot.offset") + F.pmod("_in", F.col("_slot.copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packing of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(token_pieces(docs, tokenizer_path, capacity, end_id)), capacity)
