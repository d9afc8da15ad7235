"""Substring dedup by recompression: words of passages that repeat across documents are removed, but for one document.

A window is ``width`` consecutive words of a document; each word covered by a window whose words also start in a document
with a smaller doc_id goes. Windows are judged on the input.

Recompression shortens a text in rounds: the first names runs of a repeated token, and every round names pairs. A
symbol is on the left or the right side by one bit of its hash, and a left one followed by a right one becomes one symbol. A name
is a hash of what it stands for, so equal pairs have equal names in every task and round: names are global without a table
of names or an exchange for a round. Each symbol knows its reach, the words that settle that just this symbol stands here:
its own and those of the neighbours that its rounds looked at. Equal substrings therefore have equal symbols wherever a
symbol's reach lies within them. Of the symbols whose reach lies within it, a window takes the leftmost of the highest round as
its seed; a single word's reach is the word, so each window has a seed, and equal windows have equal ones.

First pass: the seeds of all windows, and the documents that they are in; seeds of one document alone are dropped. Second pass:
runs of windows with one shared seed, segments, are hashed (128 bits over all their words: this verifies what the symbols
reveal, so nothing rests on names). Of segments with the same words those of larger doc_ids go whole, without a row for each
window. Third pass: where a seed has segments of different words, windows are hashed one by one, of what stays of each
kind of segment, and the smallest doc_id of each hash is found. Last, what is covered goes. Seeds and segments reach a pass
as bounded filters of bits, in as many rounds as it takes; texts move only for documents that lose words.

Null texts have no words. A null doc_id is larger than any other; rows that share a doc_id count as one document. Texts of
under ``width`` words keep all. A text's windows are found in slices of ``SLICE`` words that overlap by a window, so that
beyond its word hashes (16 bytes a word) memory doesn't grow with the text. An empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.llm.tables import bit_blocks, filter_bits, filter_rounds, hits, maybe, written
from cairn.llm.words import Hasher, bounds, mixed

WIDTH = 50
#: Rounds of pairs; a symbol of the last one stands for ten words or so.
ROUNDS = 8
#: Words whose windows are found at a time.
SLICE = 1 << 18
_FAR = 1 << 40


def symbols(words: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbol, reach from, reach to) before the first round and after each one, in text order. ``words`` begins and ends with a 0,
    and has one between texts; whose reach touches a 0 depends on what is not there, so they and the 0s are left out."""
    n = len(words)
    low = np.arange(n)
    high = low + 1
    low[words == 0], high[words == 0] = -_FAR, _FAR
    sym = words
    for k in range(rounds + 1):
        fixed = (low >= 0) & (high < _FAR)
        yield sym[fixed], low[fixed], high[fixed]
        if k == 0:  # runs: a run's length is settled by the neighbours that end it
            first = np.flatnonzero(np.concatenate([[True], (sym[1:] != sym[:-1]) | (sym[1:] == 0)]))
            last = np.append(first[1:], n) - 1
            length = last - first + 1
            named = np.where(length > 1, mixed(sym[first], length.astype(np.uint64), 1), sym[first])
            low, high = np.minimum(low[first], low[np.maximum(first - 1, 0)]), np.maximum(high[last], high[np.minimum(last + 1, n - 1)])
            sym = named
        side = mixed(sym, k, 2) & np.uint64(1) == 1
        left, right = ~side & (sym != 0), side & (sym != 0)
        pair, second = np.zeros(len(sym), bool), np.zeros(len(sym), bool)
        pair[:-1] = left[:-1] & right[1:]
        second[1:] = pair[:-1]
        new_low, new_high, named = low.copy(), high.copy(), sym.copy()
        alone = np.flatnonzero(right & ~second)  # stays, since no left one is before it
        new_low[alone] = np.minimum(low[alone], low[alone - 1])
        new_high[alone] = np.maximum(high[alone], high[alone - 1])
        alone = np.flatnonzero(left & ~pair)  # stays, since no right one follows
        new_low[alone] = np.minimum(low[alone], low[alone + 1])
        new_high[alone] = np.maximum(high[alone], high[alone + 1])
        at = np.flatnonzero(pair)
        named[at], new_high[at] = mixed(sym[at], sym[at + 1], 3 + k), np.maximum(high[at], high[at + 1])
        new_low[at] = np.minimum(low[at], low[at + 1])
        stay = ~second
        sym, low, high = named[stay], new_low[stay], new_high[stay]


def seeds(words: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(start, seed) of each window of ``width`` words without a 0."""
    ends = np.concatenate([[0], np.cumsum(words == 0)])
    starts = np.flatnonzero(ends[width:] == ends[:-width]) if len(words) >= width else np.zeros(0, np.int64)
    seed, todo = np.zeros(len(starts), np.uint64), np.arange(len(starts))
    for k, (sym, low, high) in reversed(list(enumerate(symbols(words)))):
        at = np.searchsorted(low, starts[todo])
        within = at < len(low)
        within[within] = high[at[within]] <= starts[todo][within] + width
        hit = todo[within]
        seed[hit] = mixed(sym[at[within]], k, 90)
        todo = todo[~within]
    return starts, seed


def window_hashes(words: np.ndarray, width: int, lane: int) -> np.ndarray:
    """A hash of each ``width`` words in a row: of its parts, whose lengths are powers of two."""
    n = len(words) - width + 1
    size, at, power, total = 1, 0, words, None
    while size <= width:
        if width & size:
            part = power[at : at + n]
            total = mixed(part, 0, lane + 100) if total is None else mixed(total, part, lane + 100 + size)
            at += size
        power = mixed(power[:-size], power[size:], lane) if 2 * size <= width else power
        size *= 2
    return total


def _slices(column: pa.Array, hasher: Hasher, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(row, place in the text, hashes) of the words of a batch's texts, a 0 after each text. Texts go in groups; one of more
    than SLICE words goes alone, in slices that overlap by a window, so where it is cut doesn't depend on the batch."""
    rows, places, hashes, held = [], [], [[] for _ in hasher.values], 0
    zero = np.zeros(1, np.uint64)
    for r, text in enumerate(column):
        data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)
        starts, ends = bounds(data)
        if len(starts) < width:
            continue
        h = hasher(data, starts, ends)
        if len(starts) > SLICE:
            for at in range(0, len(starts) - width + 1, SLICE):
                own = [x[at : at + SLICE + width - 1] for x in h]
                yield np.full(len(own[0]), r), np.arange(at, at + len(own[0])), own
            continue
        for x, y in zip(hashes, h, strict=True):
            x += [y, zero]
        rows.append(np.full(len(starts) + 1, r))
        places.append(np.arange(len(starts) + 1))
        held += len(starts)
        if held >= SLICE:
            yield np.concatenate(rows), np.concatenate(places), [np.concatenate(x) for x in hashes]
            rows, places, hashes, held = [], [], [[] for _ in hasher.values], 0
    if rows:
        yield np.concatenate(rows), np.concatenate(places), [np.concatenate(x) for x in hashes]


def _segments(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, seed): where in the slice the runs of windows with one seed begin, and their lengths, at most a window's."""
    zero = np.zeros(1, np.uint64)
    starts, seed = seeds(np.concatenate([zero, words, zero]), width)
    starts = starts - 1
    new = np.ones(len(starts), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (starts[1:] != starts[:-1] + 1)
    since = np.arange(len(starts)) - np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
    first = np.flatnonzero(since % width == 0)
    return starts[first], np.diff(np.append(first, len(starts))), seed[first]


def _piece(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mixed(row.view(np.uint64), start.astype(np.uint64), 60)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shared_seeds(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The seeds (column seed) that windows of two documents or more have. docs: _text as binary, _doc (a hash of doc_id)."""

    def run(batches):
        hasher = Hasher()
        for b in batches:
            doc = b.column(1).to_numpy()
            for row, _, (h,) in _slices(b.column(0), hasher, width):
                first, _, seed = _segments(h, width)
                yield pa.RecordBatch.from_arrays([_signed(seed), pa.array(doc[row[first]])], names=["seed", "_doc"])

    found = docs.select("_text", "_doc").mapInArrow(run, "seed long, _doc long")
    return found.groupBy("seed").agg(F.min("_doc").alias("_a"), F.max("_doc").alias("_b")).where("_a < _b").select("seed")


def _fields(docs: DataFrame, names: str) -> T.StructType:
    return T.StructType([*(T.StructField(c, T.LongType()) for c in names.split()), docs.schema["doc_id"], T.StructField("_row", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())])


def segments(docs: DataFrame, sent: Broadcast, k: int, rounds: int, width: int = WIDTH) -> DataFrame:
    """A row for each run of windows with one seed that may be shared: the seed, two hashes of its words, a number of its own,
    doc_id, _row, the first window's place and the number of windows."""
    out = _fields(docs, "seed c1 c2 piece")
    arrow = to_arrow_schema(out)

    def run(batches):
        hasher = Hasher(2)
        for b in batches:
            rows = b.column(2).to_numpy()
            for row, place, h in _slices(b.column(0), hasher, width):
                first, n, seed = _segments(h[0], width)
                own = maybe(sent.value, k, rounds, seed)
                first, n, seed = first[own], n[own], seed[own]
                if len(first):  # its first and last window cover all its words
                    hashes = [mixed(mixed(w[first], w[first + n - 1], 70), n.astype(np.uint64), 71) for w in (window_hashes(x, width, 1 + lane) for lane, x in enumerate(h))]
                    at, start = pa.array(row[first]), place[first]
                    numbers = map(_signed, (seed, *hashes, _piece(rows[row[first]], start)))
                    yield pa.RecordBatch.from_arrays([*numbers, b.column(1).take(at), b.column(2).take(at), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], schema=arrow)

    return docs.select("_text", "doc_id", "_row").mapInArrow(run, out)


def windows(docs: DataFrame, sent: Broadcast, k: int, rounds: int, width: int = WIDTH) -> DataFrame:
    """A row for each window of the segments whose number a filter may hold: two hashes, doc_id, _row, its place, 1."""
    out = _fields(docs, "w1 w2")
    arrow = to_arrow_schema(out)

    def run(batches):
        hasher = Hasher(2)
        for b in batches:
            rows = b.column(2).to_numpy()
            for row, place, h in _slices(b.column(0), hasher, width):
                first, n, _ = _segments(h[0], width)
                own = maybe(sent.value, k, rounds, _piece(rows[row[first]], place[first]))
                first, n = first[own], n[own]
                if len(first):
                    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    hashes = (_signed(window_hashes(x, width, 1 + lane)[at]) for lane, x in enumerate(h))
                    of = pa.array(row[at])
                    yield pa.RecordBatch.from_arrays([*hashes, b.column(1).take(of), b.column(2).take(of), pa.array(place[at].astype(np.int32)), pa.array(np.ones(len(at), np.int32))], schema=arrow)

    return docs.select("_text", "doc_id", "_row").mapInArrow(run, out)


LATER = "_least IS NOT NULL AND (doc_id IS NULL OR doc_id > _least)"


def covered(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, _row (a hash of doc_id and text), start, n: runs of n windows that go."""
    spark = docs.sparkSession
    shared = written(shared_seeds(docs, width))
    found = reduce(DataFrame.unionByName, [written(segments(docs, sent, k, rounds, width)) for k, rounds, sent in filter_rounds(spark, shared, "seed")])
    # segments of the same words are one class: all but those of its smallest doc_id go
    classes = written(found.groupBy("seed", "c1", "c2").agg(F.min("doc_id").alias("_least")))
    several = classes.groupBy("seed").agg(F.count("*").alias("_n")).where("_n > 1").select("seed", F.lit(True).alias("_several"))
    met = found.join(classes.join(several, "seed", "left"), ["seed", "c1", "c2"]).where(f"_several OR ({LATER})")
    met = written(met.select("doc_id", "_row", "start", "n", "_least", F.when(F.expr(f"_several AND NOT ({LATER})"), F.col("piece")).alias("piece")))
    # where a seed has several classes, the windows of what stays in each may still be in another
    first = written(met.where("piece IS NOT NULL").select("piece").distinct())
    single = reduce(DataFrame.unionByName, [written(windows(docs, sent, k, rounds, width)) for k, rounds, sent in filter_rounds(spark, first, "piece")])
    least = single.groupBy("w1", "w2").agg(F.min("doc_id").alias("_least"), F.min("_row").alias("_r1"), F.max("_row").alias("_r2")).where("_least IS NOT NULL AND _r1 < _r2").select("w1", "w2", "_least")
    goes = ["doc_id", "_row", "start", "n"]
    return met.where(LATER).select(*goes).unionByName(single.join(least, ["w1", "w2"]).where(LATER).select(*goes))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """A row per input row: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space and, if asked for,
    these as ``kept_text``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("_text"))
    rows = rows.withColumn("_doc", F.xxhash64("doc_id")).withColumn("_row", F.xxhash64("doc_id", "_text"))
    spans = covered(rows, width).groupBy("doc_id", "_row").agg(F.collect_list(F.struct("start", "n")).alias("_spans"))
    spans = written(spans.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_own"), F.col("_spans.start").alias("_starts"), F.col("_spans.n").alias("_ns")))
    bits = filter_bits(spans.count())
    rows = hits(rows, "_row", written(bit_blocks(spans, "_own", bits)), bits, "_maybe")
    whole = rows.where("NOT _maybe").withColumns({"_starts": F.lit(None).cast("array<int>"), "_ns": F.lit(None).cast("array<int>")})
    cut = rows.where("_maybe").join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_own")), "left")
    columns = ["_text", "doc_id", "_starts", "_ns"]
    out = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_text", T.StringType())] if with_text else [])])
    arrow = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            made = [_kept(*(c[i] for c in (b.column(0), b.column(2), b.column(3))), width) for i in range(b.num_rows)]
            arrays = [pa.array([m[k] for m in made], arrow.field(1 + k).type) for k in range(3)]
            texts = [pa.array([m[3].decode() for m in made], pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([b.column(1), *arrays, *texts], schema=arrow)

    return whole.select(*columns).unionByName(cut.select(*columns)).mapInArrow(run, out)


def _kept(text, starts, ns, width: int) -> tuple[int, int, str, bytes]:
    words = (text.as_py() or b"").split()
    gone = 0
    if starts.is_valid:
        at, n = starts.values.to_numpy(), ns.values.to_numpy()
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + n - 1 + width, -1)
        goes = np.cumsum(depth)[:-1] > 0
        gone = int(goes.sum())
        kept = [w for w, g in zip(words, goes.tolist(), strict=True) if not g]
    else:
        kept = words
    joined = b" ".join(kept)
    return len(words), gone, hashlib.sha256(joined).hexdigest(), joined
