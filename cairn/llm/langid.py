"""Language identification by compression: a text's language is that whose zstandard dictionary compresses it best.

Training gathers, per language, a sample of labelled texts (``SAMPLE_ROWS`` a language, chosen by a hash of key and text) and
keeps texts in hash order until the dictionary of ``DICTIONARY_BYTES`` is full, as raw dictionary content: some twenty texts
of 1,500 characters. Every value of the label is learned; beyond 200 each has a smaller share. Of a longer text it reads the first quarter of a dictionary's size (8,192 characters), so that no text
fills it alone. Every language with a letter in its texts has content, if the sample misses it by its first texts in order. Classification compresses the
whole text, in blocks of ``BLOCK`` bytes (so that long texts don't become their own dictionary), once per language, and
adds up the bytes. The score is the posterior of the winner, at ``BITS`` bits a byte saved.

A text is rejected if its margin over the second language, relative to its compressed size, or its compression by the
winner is worse than that of nearly all texts of the winner (all but ``TAIL`` of them) at its length. These limits come from
sampled texts that are held out of the dictionaries, cut to each length of ``LENGTHS``; between lengths they are
interpolated. A margin of under ``LEAST_BYTES`` bytes is rejected at any length. So texts of languages that were not learned,
mixed texts and gibberish are rejected, with a single learned language too.

Null texts and texts with no letter: ``und``, score 0, rejected. With no training rows, all texts are ``und``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.tables import with_found

#: Expected number of labelled rows taken for each language, and bytes of each dictionary.
SAMPLE_ROWS = 400
DICTIONARY_BYTES = 32 * 1024
#: Rows and bytes of all languages together. Of more languages than these hold at the figures above, each has a smaller share, of one
#: text and ``LEAST_DICTIONARY`` bytes at least, so every value of the label is learned.
ALL_ROWS, ALL_BYTES, LEAST_DICTIONARY = 80_000, 200 * DICTIONARY_BYTES, 256
BLOCK = 2048
LEVEL = 6
BITS = 1.0
#: Every HOLD-th text, and all after a dictionary is full, up to HELD_OUT a language, measure the limits.
HOLD = 4
HELD_OUT = 200
TAIL = 0.02
#: Known texts may compress worse than the limit by this factor, as the margin already rejects its share.
SLACK = 1.05
LEAST_BYTES = 2
#: Bytes of letters at which limits are measured; blocks make longer texts like the last. Shorter ones have no ratio limit.
LENGTHS = (32, 64, 128, 256, 512, 1024, 2048)
#: A limit needs so many texts of the language, else those of all languages; with fewer still, MARGIN and no ratio limit.
LEAST_TEXTS = 50
MARGIN = 0.02
_WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    """A text's words in lower case, one space apart: what is compressed, so that symbols and capitals don't weigh."""
    return " ".join(_WORDS.findall(text.lower())).encode("utf-8", "replace")


#: (least relative margin, greatest ratio of compressed size to size) at each of LENGTHS, for each language.
Limits = dict[str, list[tuple[float, float]]]


class Model(NamedTuple):
    dictionaries: dict[str, bytes]
    limits: Limits


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> Model:
    """A dictionary of at most ``size`` bytes for each language, and the limits of what is accepted. Nothing but the sample
    reaches the driver."""
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = {r.l: r.n for r in labelled.groupBy("l").agg(F.count("*").alias("n")).orderBy("l").collect()}
    if not counts:
        return Model({}, {})
    rows, size = max(1, min(rows, ALL_ROWS // len(counts))), max(LEAST_DICTIONARY, min(size, ALL_BYTES // len(counts)))
    at = F.pmod(F.xxhash64("k", "t"), F.lit(1 << 30))
    share = F.element_at(F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, min(1.0, rows / n)))), F.col("l"))
    out: dict[str, list[bytes]] = {name: [] for name in counts}
    held: dict[str, list[bytes]] = {name: [] for name in counts}
    seen = dict.fromkeys(counts, 0)

    def take(sample: DataFrame) -> None:
        for r in sample.toLocalIterator():
            data = letters(r.t)
            if not data:
                continue
            seen[r.l] += 1
            if seen[r.l] % HOLD and sum(map(len, out[r.l])) < size:
                out[r.l].append(data[: size // 4])
            elif len(held[r.l]) < HELD_OUT:
                held[r.l].append(data)

    take(labelled.where(at < share * (1 << 30)).select("l", F.substring("t", 1, size // 4).alias("t"), at.alias("at")).orderBy("at", "t"))
    missed = [name for name, texts in out.items() if not texts]
    if missed:  # their first texts in order, of all such languages at once
        lettered = labelled.where(F.col("l").isin(*missed) & F.col("t").rlike(r"\p{L}")).select("l", F.substring(F.regexp_replace("t", r"^\P{L}+", ""), 1, size // 4).alias("t"), at.alias("at"))
        order = F.row_number().over(Window.partitionBy("l").orderBy("at", "t"))
        take(lettered.withColumn("_k", order).where(F.col("_k") <= rows).select("l", "t", "at").orderBy("l", "at", "t"))
    dictionaries = {name: b" ".join(texts)[:size] for name, texts in sorted(out.items()) if texts}
    return Model(dictionaries, measured(dictionaries, held))


def measured(dictionaries: dict[str, bytes], held: dict[str, list[bytes]]) -> Limits:
    """The limits by texts held out of the dictionaries. Margins are those of the label, so below zero if another wins."""
    model = Classifier(dictionaries)
    found: dict[str, list[list[tuple[float, float]]]] = {name: [[] for _ in LENGTHS] for name in dictionaries}
    for k, name in enumerate(model.langs):
        for data in held.get(name, ()):
            for at, n in enumerate(LENGTHS):
                if len(data) >= n:
                    sizes = model.sizes(data[:n])
                    rest = min(sizes[:k] + sizes[k + 1 :], default=math.inf)
                    found[name][at].append(((rest - sizes[k]) / sizes[k], sizes[k] / n))
    limits: Limits = {}
    for name in dictionaries:
        limits[name] = []
        for at in range(len(LENGTHS)):
            for texts in (found[name][at], [x for other in found.values() for x in other[at]]):
                if len(texts) >= LEAST_TEXTS:
                    margins, ratios = (sorted(x[i] for x in texts) for i in (0, 1))
                    tail = int(len(texts) * TAIL)
                    limits[name].append((max(0.0, margins[tail]), SLACK * ratios[-1 - tail]))
                    break
            else:
                limits[name].append((MARGIN, math.inf))
    return limits


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], limits: Limits | None = None):
        import zstandard

        self.limits = limits or {}
        self.langs = list(dictionaries)
        self._packers = []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=DICTIONARY_BYTES, write_content_size=0, write_dict_id=0)
            d.precompute_compress(compression_params=params)
            self._packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        return [sum(map(len, map(pack, blocks))) for pack in self._packers]

    def limit(self, name: str, n: int) -> tuple[float, float]:
        """Least relative margin and greatest compression ratio of a text of n bytes."""
        limits = self.limits.get(name)
        if not limits or n < LENGTHS[0]:
            return (MARGIN if not limits else limits[0][0]), math.inf
        at = min(math.log2(n / LENGTHS[0]), len(limits) - 1)
        k = min(int(at), len(limits) - 2)
        (m, r), (m2, r2) = limits[k], limits[k + 1]
        mix = lambda a, b: a if a == b else max(a, b) if math.isinf(a + b) else a + (at - k) * (b - a)
        return mix(m, m2), mix(r, r2)

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether the text is rejected."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, True
        data = letters(text)
        sizes = self.sizes(data)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        score = 1 / sum(math.exp(max(-700.0, -BITS * (s - sizes[best]))) for s in sizes)
        saved = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best] + 1) - sizes[best]
        margin = saved / sizes[best]
        least, greatest = self.limit(self.langs[best], len(data))
        narrow = len(sizes) > 1 and (saved < LEAST_BYTES or margin < least)
        return self.langs[best], score, margin, narrow or sizes[best] > greatest * len(data)


OUT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def identify(docs: DataFrame, trained: Model, text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """A row per document: the columns in ``keep``, lang_pred, score, margin, rejected. The dictionaries (a bounded few
    hundred kB) travel with the tasks."""
    keep = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(trained))

    def model():
        classifier = Classifier(*shared.value)
        return lambda texts: [classifier.classify(t) for t in texts]

    return with_found(docs, text, keep, OUT, model)
