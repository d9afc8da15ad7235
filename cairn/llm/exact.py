"""Exact deduplication: two Bloom passes find possibly repeated texts, and only those rows shuffle.

Texts are equal when identical after each run of ASCII white space is one space; null counts as empty. Of equal texts the
row with the smallest doc_id stays (a null doc_id is larger than any other; of rows that repeat text and doc_id, one).

The first pass hashes every text to a bit and keeps, as a filter, the bits that two or more rows hit: a text whose bit was
hit once has no copy. The second pass hashes anew, over the rows that the first let through. A row that misses either
filter passes straight through, whole; the others are candidates, shuffle by SHA-256 and are grouped, so exactness never
rests on the filters. A group's size is summed before rows meet it; groups of over a thousandth of all candidates are at
most a thousand, and join by broadcast.

All is DataFrame code. Filters are bit arrays in blocks of 4 kB, broadcast, and never larger than ``tables.MAX_BITS`` (64
MB): there is no other path for large inputs. Up to 33 million rows a filter has 16 bits a row or more, and some 6 % of
single texts pass the first, under 1 % both. Beyond, filters fill up: at 500 million rows two in five single rows are
candidates too and shuffle, at several billion nearly all. Results stay the same; raise MAX_BITS with the executors' memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import tables
from cairn.llm.tables import bit_blocks, hits, join_groups, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per input row: doc_id, text_sha256, keep_id, group_size, kept and, as ``own_<name>``, the columns in
    ``keep``. An empty table gives no rows; other columns are ignored, whatever their names."""
    own = [f"own_{c}" for c in keep]
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("_text"), *(F.col(c).alias(f"own_{c}") for c in keep))
    rows = rows.withColumn("_h1", F.xxhash64("_text", F.lit(1))).withColumn("_h2", F.xxhash64("_text", F.lit(2)))
    hashes = written(rows.select("_h1", "_h2"))
    n = hashes.count()
    bits = tables.filter_bits(n)
    one = written(bit_blocks(hashes, "_h1", bits, least=2))
    two = written(bit_blocks(hits(hashes, "_h1", one, bits, "_maybe").where("_maybe"), "_h2", bits, least=2))
    rows = hits(hits(rows, "_h1", one, bits, "_one"), "_h2", two, bits, "_two").withColumn("text_sha256", F.sha2("_text", 256))
    rows = rows.select("doc_id", "text_sha256", *own, (F.col("_one") & F.col("_two")).alias("_maybe"))
    single = rows.where("NOT _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *own)
    candidates = rows.where("_maybe").drop("_maybe")
    ids = written(candidates.select("doc_id", "text_sha256"))
    groups = written(ids.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    met = join_groups(candidates if own else ids, groups, "text_sha256", "group_size", n)
    stays = met.where("doc_id <=> keep_id").withColumn("kept", F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(1))) == 1)
    goes = met.where("NOT (doc_id <=> keep_id)").withColumn("kept", F.lit(False))
    return single.unionByName(stays.unionByName(goes).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *own))
