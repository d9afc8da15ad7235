"""Substring dedup, phrases and hard negatives against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import hardneg, phrases, queries, substring, tables, words


def passages(seed: int, n: int, vocabulary: int, width: int) -> list[tuple]:
    """(doc_id, text, clashing columns): fresh words, passages that repeat, runs of one word, periods, copies and nulls."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randint(width - 2, 3 * width))] for _ in range(6)]
    shared += [["a"] * (2 * width), ["x", "y"] * width, ["ü"] * width + ["b"] * width]
    rows = [(None, " ".join(shared[0])), (0, None), (1, ""), (2, " \n"), (3, "one two"), (5, " ".join(shared[0])), (5, " ".join(shared[0])), (5, "other " + " ".join(shared[1]))]
    while len(rows) < n:
        out = []
        for _ in range(rng.randint(1, 5)):
            out += [word() for _ in range(rng.randint(0, width))] if rng.random() < 0.5 else rng.choice(shared)[rng.randint(0, 3) :]
        rows.append((rng.randrange(10, 10 + n), rng.choice((" ", "\n", " \t ")).join(out)))
    rows.append((4, rows[20][1]))
    return [(*r, "x", 1) for r in rows]


def removed(rows: list[tuple], width: int) -> list[tuple]:
    first: dict[tuple, int] = {}
    far = 1 << 60
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for d, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, far), far if d is None else d)
    out = []
    for d, w in split:
        goes = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (far if d is None else d):
                goes[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, goes, strict=True) if not g)
        out.append((d, len(w), sum(goes), hashlib.sha256(kept).hexdigest()))
    return out


ORDER = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))


@pytest.mark.parametrize(("seed", "vocabulary", "width", "cut"), [(1, 400, 50, None), (2, 2, 7, None), (3, 30, 20, 64), (4, 5, 50, 31)])
def test_repeats(spark, monkeypatch, seed, vocabulary, width, cut):
    if cut:
        monkeypatch.setattr(substring, "SLICE", cut)
    rows = passages(seed, 90, vocabulary, width)
    df = spark.createDataFrame(rows, "doc_id long, text string, seed string, n_words int").repartition(3)
    got = [tuple(r) for r in substring.remove_repeats(df, width=width).collect()]
    assert sorted(got, key=ORDER) == sorted(removed(rows, width), key=ORDER)
    assert any(r[2] for r in got)


def test_repeats_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(df).count() == 0


def test_repeats_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op13_substring_dedup(spark, sf).collect()]
    assert sorted(got) == sorted(removed(rows, 50))


def test_repeats_in_filter_rounds(spark, monkeypatch):
    """Seeds that pass one filter's bound go in rounds, with the same rows."""
    monkeypatch.setattr(tables, "MAX_BITS", tables.BLOCK_BITS)
    rows = passages(6, 120, 400, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string, seed string, n_words int")
    assert substring.shared_seeds(df.select(F.col("text").cast("binary").alias("_text"), F.xxhash64("doc_id").alias("_doc")), 20).count() * 400 > tables.BLOCK_BITS
    monkeypatch.setattr(tables, "BITS_PER_ROW", 400)
    got = [tuple(r) for r in substring.remove_repeats(df, width=20, with_text=True).collect()]
    assert sorted((r[:4] for r in got), key=ORDER) == sorted(removed(rows, 20), key=ORDER)
    assert all(hashlib.sha256(r[4].encode()).hexdigest() == r[3] for r in got)


def test_equal_windows_have_equal_seeds():
    rng = np.random.default_rng(3)
    for vocabulary in (2, 9, 1000):
        found: dict[tuple, int] = {}
        for _ in range(40):
            text = np.concatenate([[0], rng.integers(1, vocabulary + 1, 300), [0]]).astype(np.uint64)
            if found:
                text[40:140] = shared
            starts, seed = substring.seeds(text, 20)
            assert len(starts) == 281
            for s, x in zip(starts.tolist(), seed.tolist(), strict=True):
                assert found.setdefault(tuple(text[s : s + 20].tolist()), x) == x
            shared = text[100:200].copy()


def test_word_hashes_of_long_words(monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 16)
    h, text = words.Hasher(2), b" ab " + b"x" * 50 + b"\x0bab " + b"x" * 50 + b" " + b"x" * 51 + b" c"
    data = np.frombuffer(text, np.uint8)
    for lane in h(data, *words.bounds(data)):
        a, b, c, d, e, f = lane.tolist()
        assert a == c and b == d and len({a, b, e, f}) == 4 and all(lane)


# phrases -------------------------------------------------------------------------------------------------------------
def brute_phrases(rows, most, least, share, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, most + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = []
    for lang in n:
        cands = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in cands.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= share * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return out


def talk(seed=4, n=120):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "ÉTÉ", "été", "new", "york", " x", "q\x1cz", "日本", "\x00", *(f"w{k}" for k in range(40))]
    rows = [(0, None, "en"), (1, "", None), (2, "a b a b a b a b a b a b a b a b a b a b a b a b", None), (3, "one.two!three\x0bfour\rfive", "und"), (4, " ".join(["go"] * 60), "de")]
    while len(rows) < n:
        words = [rng.choice(vocabulary[: rng.choice((8, 51))]) + rng.choice(("", "", "", "", ",", ".", "!")) for _ in range(rng.randint(0, 80))]
        rows.append((len(rows), rng.choice((" ", "  ", "\t", " \n")).join(words), rng.choice(("en", "en", "en", "de", None))))
    return rows


@pytest.mark.parametrize(("most", "least", "share", "top"), [(3, 10, 50, 2000), (4, 3, 70, 25), (2, 5, 50, 10)])
def test_phrases(spark, monkeypatch, most, least, share, top):
    monkeypatch.setattr(phrases, "SLOT", 500)
    monkeypatch.setattr(phrases, "HELD", 700)
    monkeypatch.setattr(phrases, "BYTES", 1500)
    df = spark.createDataFrame([(*r, 1, "x") for r in talk()], "doc_id long, text string, lang string, n int, phrase string").repartition(3)
    got = [tuple(r) for r in phrases.mine(df, most=most, least=least, share=share, top=top).collect()]
    assert sorted(got) == sorted(brute_phrases(talk(), most, least, share, top)) and len(got) > 5
    assert phrases.mine(df.where("doc_id < 0")).count() == 0


def test_summaries_keep_what_is_frequent():
    """Merged in any order, summaries lose no key with ``least`` occurrences, and hold no more than their capacity."""
    rng = np.random.default_rng(1)
    stream = np.concatenate([rng.integers(0, 3000, 20_000), np.repeat(np.arange(9000, 9040), 25)]).astype(np.uint64)
    rng.shuffle(stream)
    capacity = len(stream) // 25 + 1
    keys, counts, lost = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for part in np.array_split(stream, 37):
        k, c = phrases.summed(part)
        keys, counts = phrases.summed(np.concatenate([keys, k]), np.concatenate([counts, c]))
        keys, counts, taken = phrases.trimmed(keys, counts, capacity)
        lost += taken
        assert len(keys) <= capacity
    assert lost < 25
    true = Counter(stream.tolist())
    kept = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    assert all(kept.get(k, 0) + lost >= n >= kept.get(k, 0) for k, n in true.items())
    assert {k for k, n in true.items() if n >= 25} <= kept.keys()


# hard negatives ------------------------------------------------------------------------------------------------------
def brute_negatives(rows, positives=5, negatives=3):
    own = [(k, i, label, v) for k, (i, label, v) in enumerate(rows) if label is not None and v is not None and None not in v]
    far = 1 << 62
    score = lambda a, b: sum(x * y for x, y in zip(a[3], b[3], strict=False))
    out = []
    for a in own:
        if a[1] is None or a[1] % 5:
            continue
        ranked = sorted(((-score(a, b), far if b[1] is None else b[1], b) for b in own if b[0] != a[0]), key=lambda x: x[:2])
        for s, i, b in [x for x in ranked if x[2][2] == a[2]][:positives]:
            found = [(t, j) for t, j, c in ranked if c[2] != a[2] and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a[1], None if i == far else i, k, None if j == far else j, -s, -t) for k, (t, j) in enumerate(found, 1)]
    return out


def vectors(kind: str, n: int = 160):
    rng = random.Random(kind)
    size = {"small": 12, "wide": 600, "ragged": 9, "large": 5}[kind]
    most = {"small": 3, "wide": 900, "ragged": 40, "large": 1 << 28}[kind]
    rows = [(0, 1, None), (5, None, [1] * size), (10, 1, []), (15, 1, [1, None]), (None, 1, [most] * size), (20, 7, [1] * size)]
    while len(rows) < n:
        v = [rng.randint(-most, most) + (most // 2 if rng.random() < 0.4 else 0) for _ in range(size if kind != "ragged" else rng.randint(0, size))]
        rows.append((len(rows), rng.choice((1, 1, 1, 2, 3)), v))
    return rows


@pytest.mark.parametrize("kind", ["small", "wide", "ragged", "large"])
def test_hard_negatives(spark, monkeypatch, kind):
    monkeypatch.setattr(hardneg, "LEAST", 20)
    monkeypatch.setattr(hardneg, "BLOCK", 30)
    monkeypatch.setattr(hardneg, "TILE", 50)
    rows = vectors(kind)
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "vec_id long, label int, vector array<long>, score string, key int").repartition(3)
    got = [tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 5 == 0).collect()]
    assert sorted(got, key=str) == sorted(brute_negatives(rows), key=str) and got


def test_hard_negatives_repeated_rows(spark):
    rows = [(5, 1, [3, 1]), (5, 1, [3, 1]), (7, 2, [2, 1]), (7, 2, [2, 1]), (9, 2, [2, 1]), (11, 2, [2, 0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    got = sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 5 == 0).collect())
    assert got == sorted(2 * [(5, 5, 1, 7, 10, 7), (5, 5, 2, 7, 10, 7), (5, 5, 3, 9, 10, 7)])
    assert hardneg.mine(df.where("vec_id < 0"), F.col("vec_id") % 5 == 0).count() == 0
    with pytest.raises(ValueError, match="62 bits"):
        hardneg.mine(df.withColumn("vector", F.array(F.lit(1 << 40))), F.col("vec_id") % 5 == 0)


def test_valid_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0, None]), (2, 1, [nan]), (3, 1, [-inf]), (4, None, [1.0]), (5, 1, None), (6, 1, []), (7, 1, [1e300])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(r.vec_id for r in df.where(hardneg.valid(F.col("label"), F.col("embedding"))).collect()) == [6, 7]
