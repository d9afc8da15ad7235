"""Quality rules as a short-circuit cascade ordered by measured rejection per cost, all in DataFrame functions.

A rule says from the raw text whether it rejects it. ``order_rules`` runs each rule over a sample (``SAMPLE_ROWS`` expected
rows, drawn row by row, so neither nulls nor a text that many rows share weigh more than their share), takes its time beyond
a job that only reads the sample as its cost and the share of rows it rejects as its selectivity, and orders rules by
rejection per cost; scores within a factor of two count as equal and keep the order they were declared in. ``cascade``
evaluates the rules in that order inside one CASE, so a rejected row meets no later rule, and what a rule measures is
computed in its branch only. The order changes the time and which rule is named, never whether a row is rejected.

``judge`` is that cascade over all rules, the base rules (too few words, repeated passages) among them. The registered query
also returns the base measures, which must then be computed for every row; its rules read these columns, so its cascade
spares no more than what they need beyond them.

Words are runs of anything but ASCII white space. Null texts have no words. Words are compared by 64-bit hashes in windows:
two different windows with one hash would count as a repeat.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2_000
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
LEAST_WORDS, REPEAT_PERCENT = 10, 20


class Measures:
    """What rules read: the whole text, and its measures, computed where they are read or taken from columns that have
    them."""

    def __init__(self, text: Column, known: bool = False):
        self.text, self._known = whole(text), known

    def __getattr__(self, name: str) -> Column:
        if name not in MEASURES:
            raise AttributeError(name)
        return F.col(name) if self._known else MEASURES[name](self.text)


@dataclass(frozen=True)
class Rule:
    """Rejects rows where ``fails`` of their measures holds."""

    name: str
    fails: Callable[[Measures], Column]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(whole(text), SPACE, -1), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(whole(text), " \t\n\x0b\x0c\r", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(whole(text)) - F.char_length(F.translate(whole(text), "#*$%&|<>", ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(whole(text), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _places(windows: Column) -> Column:
    """How many words the windows cover that occur twice or more. Sorted by hash, neighbours with one hash are repeats."""
    ordered = F.array_sort(F.transform(windows, lambda v, k: F.struct(v.alias("v"), k.alias("k"))))
    none = F.array().cast("array<int>")
    pairs = let(ordered, lambda s: F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.when(a["v"] == b["v"], F.array(a["k"], b["k"])).otherwise(none)))
    places = F.array_sort(F.array_distinct(F.flatten(pairs)))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda s, k: F.struct(k.alias("last"), (s["n"] + F.least(F.lit(WINDOW), k - s["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda s: s["n"])


def repeat_words(items: Column) -> Column:
    """Words in windows of five that the list has twice or more. Only texts with a repeated window sort theirs."""
    hashes = F.transform(items, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda k: F.xxhash64(*(F.get(h, k + j) for j in range(WINDOW))))
    repeats = lambda h: let(windows(h), lambda v: F.when(F.size(F.array_distinct(v)) < F.size(v), _places(v)).otherwise(0))
    return let(hashes, lambda h: F.when(F.size(h) > WINDOW, repeats(h)).otherwise(0)).cast("long")


def n_repeat_words(text: Column) -> Column:
    return repeat_words(words(text))


MEASURES = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all measures of the whole text; its words are split once."""
    split = {"n_words": lambda w: F.size(w).cast("long"), "n_repeat_words": repeat_words}
    one = [(split[name](F.col("_words")) if name in split else measure(F.col(text))).alias(name) for name, measure in MEASURES.items()]
    return docs.withColumn("_words", words(F.col(text))).select(*docs.columns, *one)


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda m: m.n_words < LEAST_WORDS),
        Rule("repeated_passages", lambda m: 100 * m.n_repeat_words > REPEAT_PERCENT * m.n_words),
    ]


def rules() -> list[Rule]:
    """Wide bounds: prose of any kind passes; rows made of symbols, copied lines or unbroken runs don't. None rejects an
    empty text."""
    letters = lambda m: F.char_length(F.regexp_replace(m.text, r"[^\p{L}]+", ""))
    return [
        Rule("symbols", lambda m: m.n_symbols * 10 > m.word_chars),
        Rule("copied_lines", lambda m: m.n_dup_lines * 2 > F.size(F.split(m.text, "\n", -1))),
        Rule("word_length", lambda m: let(F.struct(m.word_chars.alias("c"), m.n_words.alias("n")), lambda x: (x["c"] > 25 * x["n"]) | (x["c"] < 2 * x["n"]))),
        Rule("letters", lambda m: letters(m) * 2 < m.word_chars),
        Rule("replacement_characters", lambda m: F.char_length(m.text) - F.char_length(F.translate(m.text, "\ufffd", "")) > m.n_words),
    ]


def ranked(measured: list[tuple[float, float]]) -> list[int]:
    """The order of rules with these (seconds, rejected share): by rejection per second, in steps of a factor of two; ties in
    their own order, rules that reject nothing last and the cheapest of them first."""
    step = lambda x: round(math.log2(max(x, 1e-9)))
    key = lambda k: (-step(measured[k][1] / measured[k][0]), k) if measured[k][1] else (math.inf, step(measured[k][0]), k)
    return sorted(range(len(measured)), key=key)


def order_rules(docs: DataFrame, candidates: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost on a sample of about ``rows`` rows; their own order where there are no rows."""
    n = docs.count()
    if not n:
        return list(candidates)
    sample = docs.select(F.col(text).alias("t")).sample(min(1.0, rows / n), seed=11).persist()
    try:

        def timed(condition: Column) -> tuple[float, int]:
            best, hits = math.inf, 0
            for _ in range(2):
                began = time.perf_counter()
                hits = sample.agg(F.count_if(condition)).first()[0]
                best = min(best, time.perf_counter() - began)
            return best, hits

        seen = max(1, sample.count())
        floor, _ = timed(F.lit(True))
        found = [timed(rule.fails(Measures(F.col("t")))) for rule in candidates]
        return [candidates[k] for k in ranked([(max(seconds - floor, 1e-3), hits / seen) for seconds, hits in found])]
    finally:
        sample.unpersist()


def cascade(ordered: list[Rule], measures: Measures) -> Column:
    """The name of the first rule that rejects the row, or null."""
    out = F.lit(None).cast("string")
    for rule in reversed(ordered):
        out = F.when(rule.fails(measures), rule.name).otherwise(out)
    return out


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with rejected_by (the first rule of the cascade that rejects the row, null for none) and kept."""
    ordered = order_rules(docs, base_rules() + rules(), text)
    return docs.withColumn("rejected_by", cascade(ordered, Measures(F.col(text)))).withColumn("kept", F.col("rejected_by").isNull())


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all measures, base_failed, rejected_by (null where the base fails) and kept: the cascade runs behind the
    base rules, and reads the measures from their columns."""
    ordered = order_rules(docs, rules(), text)
    known = Measures(F.col(text), known=True)
    failed = base_rules()[0].fails(known) | base_rules()[1].fails(known)
    docs = measures(docs, text).withColumn("base_failed", failed)
    docs = docs.withColumn("rejected_by", F.when(~F.col("base_failed"), cascade(ordered, known)))
    return docs.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
