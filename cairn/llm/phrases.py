"""Phrase collocations: every frequent run of words of a language, scored by its weakest cut.

Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line ends, and pieces into words. A phrase counts
within pieces, overlaps included. Candidates are phrases of two words or more with ``least`` occurrences; a cut after the first k
words scores a * a / (l * r), the lowest cut counts. A candidate goes if a longer one that holds it has ``share`` per cent
of its occurrences. The first ``top`` of each language are given.

How frequent phrases are found: occurrences of one to ``most`` words are dealt into slots by their hashes. Each task sums up what
it reads of a slot in a summary, and the summaries of a slot are merged as Misra and Gries's are: of more counters than
the capacity, the value of the first one too many is taken from all, and those that reach 0 go. A slot's capacity exceeds its
mass (its occurrences, counted first) divided by ``least``, so what is taken adds up to less than ``least``: every phrase with
``least`` occurrences survives. There are so many slots that a summary fits a task, whatever the input. A second pass counts
the survivors exactly, by their words. It meets them as filters of bits of bounded size, in as many rounds as that takes.

Null texts have no words, a null language is ``und``. An empty table gives no rows; other columns are ignored, whatever their
names. Scores and counts are exact: products are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.tables import filter_rounds, maybe, written
from cairn.llm.words import Hasher, bounds, mixed

#: Occurrences of a slot, as expected from the length of all texts; its summary has this many counters by ``least`` or so.
SLOT = 1 << 21
#: Occurrences that a task holds before it sums them up, and bytes of text that it splits at a time.
HELD, BYTES = 1 << 21, 1 << 21
# fixed: what parts pieces, and words within them
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = _PIECE.copy()
_WORD[[0x20, 0x09]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Part:
    """Texts of one language: their bytes and the words in them, by piece."""

    def __init__(self, lang: str | None, texts: list[bytes], hasher: Hasher):
        self.lang = "und" if lang is None else lang
        self.bytes = b"\n".join(texts).translate(_LOWER)
        data = np.frombuffer(self.bytes, np.uint8) if self.bytes else np.zeros(0, np.uint8)
        self.starts, self.ends = bounds(data, _WORD)
        piece = np.cumsum(_PIECE[data], dtype=np.int32)[self.starts] if len(self.starts) else np.zeros(0, np.int32)
        salt = int.from_bytes(self.lang.encode()[:6], "little") + 1
        self.hashes = [mixed(h, lane, salt) for lane, h in enumerate(hasher(data, self.starts, self.ends))]
        self.piece = piece

    def occurrences(self, most: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """(words, places, hashes by lane) of all runs of 1 to ``most`` words within pieces."""
        at, h = np.arange(len(self.starts)), self.hashes
        for m in range(1, most + 1):
            if m > 1:
                at = at[: len(at) - int(len(at) and at[-1] + m > len(self.starts))]
                same = self.piece[at] == self.piece[at + m - 1]
                at, h = at[same], [x[: len(same)][same] for x in h]
                h = [mixed(x, w[at + m - 1], m) for x, w in zip(h, self.hashes, strict=True)]
            yield m, at, h

    def phrase(self, at: int, m: int) -> bytes:
        return b" ".join(self.bytes[self.starts[at] : self.ends[at + m - 1]].split())


def parts(batch: pa.RecordBatch, hasher: Hasher) -> Iterator[Part]:
    """The texts of a batch (text as binary, lang), by language, some megabytes at a time."""
    held: dict[str | None, list[bytes]] = {}
    size: dict[str | None, int] = {}
    for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if not text:
            continue
        held.setdefault(lang, []).append(text)
        size[lang] = size.get(lang, 0) + len(text)
        if size[lang] > BYTES:
            yield Part(lang, held.pop(lang), hasher)
            size[lang] = 0
    for lang, texts in held.items():
        if texts:
            yield Part(lang, texts, hasher)


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each hash: a range of hashes, so that sorted ones are in order of slot."""
    return ((keys >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def trimmed(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A summary of at most ``capacity`` counters, and what was taken from each: the value of the first one too many."""
    if len(keys) <= capacity:
        return keys, counts, 0
    taken = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    stay = counts > taken
    return keys[stay], counts[stay] - taken, taken


def masses(docs: DataFrame, most: int, slots: int) -> tuple[DataFrame, DataFrame]:
    """(slot, mass) of all occurrences, and (lang, n) of all words."""

    def run(batches):
        hasher, mass, n = Hasher(), np.zeros(slots, np.int64), {}
        for b in batches:
            for part in parts(b, hasher):
                n[part.lang] = n.get(part.lang, 0) + len(part.starts)
                for _, _, (h,) in part.occurrences(most):
                    mass += np.bincount(slot_of(h, slots), minlength=slots)
        full = np.flatnonzero(mass)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(full), "lang": pa.nulls(len(full), pa.string()), "n": pa.array(mass[full])})
        yield pa.RecordBatch.from_pydict({"slot": pa.nulls(len(n), pa.int64()), "lang": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    found = written(docs.mapInArrow(run, "slot long, lang string, n long").groupBy("slot", "lang").agg(F.sum("n").alias("n")))
    return found.where("slot IS NOT NULL").select("slot", F.col("n").alias("mass")), found.where("slot IS NULL").select("lang", "n")


def survivors(docs: DataFrame, mass: DataFrame, most: int, least: int, slots: int) -> DataFrame:
    """Hashes (column h) of phrases that may have ``least`` occurrences: all that have, and few others."""

    def summaries(batches):
        hasher, held, size = Hasher(), [], 0

        def flush():
            keys, counts = summed(np.concatenate(held))
            slot = slot_of(keys, slots)
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            ends = np.append(first[1:], len(keys))
            counts = counts.astype(np.int32)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slot[first]), "keys": pa.array([keys[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())})

        for b in batches:
            for part in parts(b, hasher):
                for _, _, (h,) in part.occurrences(most):
                    held.append(h)
                    size += len(h)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
                    pa.default_memory_pool().release_unused()
        if size:
            yield from flush()

    def merge(batches):
        keys, counts, lost = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for b in batches:
            if b.num_rows:
                capacity = b.column(3)[0].as_py() // least + 1
                more = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()], [np.frombuffer(x, np.int32).astype(np.int64) for x in b.column(2).to_pylist()]
                keys, counts = summed(np.concatenate([keys, *more[0]]), np.concatenate([counts, *more[1]]))
                keys, counts, taken = trimmed(keys, counts, capacity)
                lost += taken
        found = keys[counts + lost >= least]
        yield pa.RecordBatch.from_pydict({"h": pa.array(found.view(np.int64))})

    made = docs.mapInArrow(summaries, "slot long, keys binary, counts binary")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merge(batches)

    return made.join(mass, "slot").select("slot", "keys", "counts", "mass").groupBy("slot").applyInArrow(merged, "h long")


def counted(docs: DataFrame, sent, k: int, rounds: int, most: int) -> DataFrame:
    """lang, phrase, m (its words), n: partial counts of phrases that a filter may hold."""

    def run(batches):
        hasher = Hasher(2)
        for b in batches:
            for part in parts(b, hasher):
                langs, phrases, words, ns = [], [], [], []
                for m, at, (h, g) in part.occurrences(most):
                    own = maybe(sent.value, k, rounds, h)
                    at, h, g = at[own], h[own], g[own]
                    order = np.lexsort((g, h))  # by both hashes: equal phrases lie together
                    h, g = h[order], g[order]
                    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.zeros(0, np.int64)
                    phrases += [part.phrase(p, m) for p in at[order][first].tolist()]
                    ns.append(np.diff(np.append(first, len(h))))
                    words += [m] * len(first)
                langs = pa.array([part.lang]).take(pa.array(np.zeros(len(phrases), np.int32)))
                yield pa.RecordBatch.from_arrays([langs, pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(words, pa.int32()), pa.array(np.concatenate(ns), pa.int64())], names=["lang", "phrase", "m", "n"])

    return docs.mapInArrow(run, "lang string, phrase string, m int, n long")


def frequent(docs: DataFrame, most: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of all phrases of 1 to ``most`` words with ``least`` occurrences, and (lang, n)."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    slots = max(1, -(-chars * most // (2 * SLOT)))
    mass, n = masses(docs, most, slots)
    kept = written(survivors(docs, mass, most, least, slots))
    found = None
    for k, rounds, sent in filter_rounds(docs.sparkSession, kept, "h"):
        some = written(counted(docs, sent, k, rounds, most).groupBy("lang", "phrase", "m").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
        found = some if found is None else found.unionByName(some)
    return found, n


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score."""
    rows = docs.select(F.col(text).cast("string").cast("binary").alias("text"), F.col(lang).cast("string").alias("lang"))
    grams, n = frequent(rows, most, least)
    several = grams.where("m > 1").withColumnRenamed("f", "a")
    cut = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).withColumn("_left", F.expr("substring_index(phrase, ' ', k)"))
    cut = cut.withColumn("_right", F.expr("substring(phrase, length(_left) + 2)"))
    side = lambda name, f: grams.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cut.join(side("_left", "l"), ["lang", "_left"]).join(side("_right", "r"), ["lang", "_right"])
    exact = lambda c: f"cast({c} as decimal(19, 0))"
    cut = cut.withColumn("score", F.expr(f"cast(1000000 as decimal(7, 0)) * cast({exact('a')} * {exact('a')} as decimal(31, 0)) div cast({exact('l')} * {exact('r')} as decimal(38, 0))"))
    worst = cut.groupBy("lang", "phrase", "m", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_w"))
    longer = several.where("m > 2").withColumn("_words", F.split("phrase", " ")).withColumn("_size", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
    within = longer.select("lang", F.col("a").alias("_a"), F.explode(F.expr("transform(sequence(1, m - _size + 1), i -> array_join(slice(_words, i, _size), ' '))")).alias("phrase"))
    within = within.groupBy("lang", "phrase").agg(F.max("_a").alias("_longer"))
    kept = worst.join(within, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("_w.score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("_w.l").alias("l"), F.col("_w.r").alias("r"), "n", F.col("_w.score").alias("score"))
