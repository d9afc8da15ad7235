"""Toxicity scores from gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a learned and of a fixed lexicon, their densest window, second-person words near a
lexicon word, shares of capitals, punctuation and obfuscated words (letters mixed with digits or symbols), and how many
of those read as lexicon words once digits and symbols are mapped back.

Training takes at most about ``TRAIN_ROWS`` labelled keys (by a hash of the key). The lexicon is the words whose document
frequencies differ most between the labels, counted on Spark; trees and calibration are fitted to the rows' features.
A fifth of the rows is kept from the trees and calibrates them. Null texts count as empty; they get a score like others.
With no labelled rows, or one label only, all scores are the share of that label.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of training: labelled rows, and words of the learned lexicon.
TRAIN_ROWS = 30_000
LEXICON_WORDS = 300
MIN_DOCUMENTS = 4
#: Words also count by their first letters, so that an inflected or compounded form is known by its stem.
PREFIXES = (4, 5)
#: Plain insults and second-person words in the languages at hand.
INSULTS = frozenset("idiot idiots moron morons stupid dumb scum trash garbage loser losers pathetic worthless disgusting clown clowns fool fools hate kill idiota imbécile imbécil estúpido estúpida basura asco crétin débile ordure ridicule stupide dumm dummkopf trottel abschaum müll versager widerlich".split())
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!|", "oleastasil")
NEAR, WINDOW = 4, 20
_TOKEN = re.compile(r"[^\s]+")
_EDGE = ".,;:!?\"'()[]{}*#%&<>|-_…»«¿¡"
FEATURES = 14


def words_of(text: str) -> list[str]:
    return [w.strip(_EDGE).lower() for w in text.split()]


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    words = words_of(text)
    n = max(1, len(words))
    get = lexicon.get
    hits = [(k, v) for k, w in enumerate(words) if (v := get(w) or get(w[: PREFIXES[0]] + "*") or get(w[: PREFIXES[1]] + "*")) is not None]
    fixed = sum(w in INSULTS for w in words)
    odd = [w for w in words if w and not w.isalpha() and any(map(str.isalpha, w))]
    read = sum((m := w.translate(LEET).replace("*", "").replace(".", "").replace("-", "")) in INSULTS or m in lexicon for w in odd)
    total = sum(v for _, v in hits)
    close, densest, back = 0, 0, 0
    places = [k for k, _ in hits]
    if places:
        here = set(places)
        close = sum(any(k + d in here for d in range(-NEAR, NEAR + 1)) for k, w in enumerate(words) if w in SECOND_PERSON)
        for k, at in enumerate(places):
            while places[back] <= at - WINDOW:
                back += 1
            densest = max(densest, k - back + 1)
    size = max(1, len(text))
    capitals = len(re.findall(r"[A-ZÄÖÜÉÈÀÇÑÁÍÓÚ]", text))
    return [
        np.log1p(len(words)), len(hits), len(hits) / n, total, total / n, len({words[k] for k in places}), max((v for _, v in hits), default=0.0), densest,
        fixed, fixed / n, close, capitals / size, (text.count("!") + text.count("?")) / size, (len(odd) + 5 * read) / n,
    ]


def learn_lexicon(labelled: DataFrame, words: int = LEXICON_WORDS) -> dict[str, float]:
    """The words whose document frequency differs most between the labels, with their log odds. labelled: text, toxic."""
    edge = "[" + re.escape(_EDGE).replace("…", "…") + "]+"
    tokens = F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: F.lower(F.regexp_replace(F.regexp_replace(w, "^" + edge, ""), edge + "$", "")))
    stems = [F.transform(tokens, lambda w, n=n: F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit("*"))).otherwise("")) for n in PREFIXES]
    seen = labelled.select("toxic", F.explode(F.array_distinct(F.concat(tokens, *stems))).alias("word")).where(F.length("word").between(2, 40))
    counts = seen.groupBy("word").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).where(F.col("n") >= MIN_DOCUMENTS)
    totals = labelled.agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).first()
    if not totals.n or not totals.pos or totals.pos == totals.n:
        return {}
    share = totals.pos / totals.n
    pos, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    part = lambda k, s: F.when(k > 0, k * F.log(k / (F.col("n") * F.lit(s)))).otherwise(F.lit(0.0))
    odds = F.log((pos + 0.5) / (neg + 0.5)) - F.lit(float(np.log(share / (1 - share))))
    sure = counts.withColumn("odds", odds).withColumn("z", F.sqrt(F.greatest(F.lit(0.0), 2 * (part(pos, share) + part(neg, 1 - share))))).where("z > 4.5 AND odds > 1")
    return {r.word: float(r.odds) for r in sure.orderBy(F.desc("z"), "word").limit(words).collect()}


@dataclass
class Boosted:
    """Trees of depth three on binned features; logistic loss."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    depth: int = 3

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.12, bins: int = 48, l2: float = 2.0) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = self._bin(x)
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), int)
            feats, cuts = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, bins + 1)
            for d in range(self.depth):
                for k in range(2**d):
                    at, mine = 2**d - 1 + k, node == k
                    best = 1e-9
                    gs, hs = g[mine].sum(), h[mine].sum()
                    for f in range(x.shape[1]):
                        gl = np.cumsum(np.bincount(b[mine, f], g[mine], bins + 1))[:-1]
                        hl = np.cumsum(np.bincount(b[mine, f], h[mine], bins + 1))[:-1]
                        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                        gain[(hl < 2) | (hs - hl < 2)] = 0
                        c = int(gain.argmax())
                        if gain[c] > best:
                            best, feats[at], cuts[at] = gain[c], f, c
                node = 2 * node + (b[np.arange(len(y)), feats[2**d - 1 + node]] > cuts[2**d - 1 + node])
            leaf = np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + l2) * rate
            score = score + leaf[node]
            self.trees.append((feats, cuts, leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        score = np.full(len(x), self.base)
        for feats, cuts, leaf in self.trees:
            node = np.zeros(len(x), int)
            for d in range(self.depth):
                node = 2 * node + (b[np.arange(len(x)), feats[2**d - 1 + node]] > cuts[2**d - 1 + node])
            score += leaf[node]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of the calibration curve. Each end is drawn in by half a row of the other label."""
    blocks: list[list[float]] = []
    for s, v in sorted(zip(score.tolist(), y.tolist(), strict=True)):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], hi]
    xs = [x for b in blocks for x in (b[2], b[3])]
    ps = [(b[0] + 0.25) / (b[1] + 0.5) for b in blocks for _ in (0, 1)]
    return np.array(xs), np.maximum.accumulate(np.array(ps))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None
    constant: float = 0.0

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], float).reshape(-1, FEATURES)
        if self.trees is None or not len(x):
            return np.full(len(x), self.constant)
        return np.interp(self.trees.predict(x), *self.knots)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """A model from ``docs`` (key, text) and ``labels`` (key, toxic: 0 or 1; others are ignored; of several labels of a key
    the larger counts). At most about ``rows`` keys are sampled from the labels, and these meet the documents by broadcast,
    so only their texts shuffle, to one a key: of rows that
    share a key the least text counts, so repeated keys don't pass the bound. What reaches the driver is their features and ``LEXICON_WORDS`` words."""
    from cairn.llm.tables import written

    labels = written(labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    n = labels.count()
    at = F.pmod(F.xxhash64(F.col("_key").cast("string")), F.lit(1 << 30))
    chosen = labels.where(at < int(min(1.0, rows / max(n, 1)) * (1 << 30))).withColumn("fold", at % 5)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    sample = written(texts.join(F.broadcast(chosen), "_key").groupBy(F.col("_key").cast("string").alias("k"), "toxic", "fold").agg(F.min("text").alias("text")))
    lexicon = learn_lexicon(sample.where("fold < 4"))
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("toxic", T.IntegerType()), T.StructField("fold", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), pa.array([features(t.as_py(), lexicon) for t in b.column(1)], pa.list_(pa.float64()))], names=["k", "toxic", "fold", "x"])

    got = sorted(sample.select("k", "text", "toxic", "fold").mapInArrow(run, schema).collect())
    x, y = np.array([r.x for r in got], float).reshape(-1, FEATURES), np.array([r.toxic for r in got], float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, constant=float(y.mean()) if len(y) else 0.0)
    held = np.array([r.fold == 4 for r in got])
    if held.all() or not held.any() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    trees = Boosted().fit(x[~held], y[~held])
    fit_on = held if held.any() and y[held].min() < y[held].max() else ~held
    return Model(lexicon, trees, isotonic(trees.predict(x[fit_on]), y[fit_on]))


def score(docs: DataFrame, model: Model, keep: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in ``keep`` and ``score`` of each row. The model (some hundred kB at most) travels with the tasks."""
    from cairn.llm.tables import with_found

    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_found(docs, text, list(keep), [T.StructField("score", T.DoubleType())], lambda: lambda texts: [(float(s),) for s in shared.value.scores(texts)])
