"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from minutes.llm import phrases


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, longest, least, percent, most):
    count = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    count[lang or ("und" if lang is None else lang)][tuple(words[i : i + n])] += 1
    out = []
    for lang, c in count.items():
        found = {p: n for p, n in c.items() if len(p) > 1 and n >= least}
        total = sum(n for p, n in c.items() if len(p) == 1)
        scored = []
        for p, a in found.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: B023, E731
            if any(inside(q) and 100 * n >= percent * a for q, n in found.items()):
                continue
            s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total, -s))
    return sorted(out)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(t, lang, 1, "x") for lang, t in rows], "text string, lang string, n int, phrase string")


WORDS = ["the", "The", "of", "ü", "Ü", "x\x00y", "new", "york", "city", "a", "日本", "\x01", "b-c", "of　"]


def sample(seed, docs, words):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    text = lambda: "".join(rng.choices(WORDS, weights)[0] + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " \r\n", "!"]) for _ in range(rng.randint(0, words)))
    return [(rng.choice(["en", "en", "en", None, "und", "", "de"]), text()) for _ in range(docs)]


def test_against_plain_counts(spark):
    rows = [*sample(1, 120, 60), ("en", None), ("en", ""), ("fr", "!!! ..."), (None, " new york city " * 15), ("en", "new york. " * 12 + "york city, " * 30), *[("en", "one line that many texts share")] * 25]
    docs = frame(spark, rows).repartition(3)
    assert got(phrases.collocations(docs)) == plain(rows, 3, 10, 50, 2000)
    assert got(phrases.collocations(docs, longest=5, least=3, percent=30, most=40)) == plain(rows, 5, 3, 30, 40)
    assert phrases.collocations(docs.limit(0)).collect() == [] and phrases.collocations(frame(spark, [("en", "a b")])).collect() == []


def test_bounds_lose_nothing(spark, monkeypatch):
    """Texts longer than what is gathered, prefixes that exceed what a task holds, common words, and rounds of ranks."""
    rows = [("en", " ".join(t for _, t in sample(2, 60, 60))), *sample(3, 80, 50), ("en", "w " * 3000)]
    docs = frame(spark, rows).repartition(2)
    want = plain(rows, 3, 10, 50, 2000)
    assert got(phrases.collocations(docs, gather=50, hold=3)) == want
    monkeypatch.setattr(phrases, "SHARE", 3)
    assert got(phrases.collocations(docs, gather=97, hold=10_000)) == want
    monkeypatch.setattr(phrases, "GROUP", 8)
    assert got(phrases.collocations(docs, least=3, most=2)) == plain(rows, 3, 3, 50, 2)


def test_scores_are_exact(spark):
    rng = random.Random(4)
    rows = [(a := rng.randint(1, 10**15), rng.randint(a, 9 * 10**15), rng.randint(a, 9 * 10**15)) for _ in range(300)] + [(1, 1, 1), (10**15, 10**15, 10**15), (3_000_000_019, 3_000_000_019, 9 * 10**15)]
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", phrases.score(F.col("a"), F.col("l"), F.col("r")))
    assert dict(df.dtypes)["s"] == "bigint"
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in df.collect())


def test_a_prefix_is_grown_depth_first():
    tails = {b"york city": 6, b"york state": 5, b"york": 4, b"jersey city": 9, b"": 30}
    assert list(phrases.grow(b"new", tails, 5)) == [(b"new york", 15), (b"new york city", 6), (b"new york state", 5), (b"new jersey", 9), (b"new jersey city", 9)]
    assert list(phrases.grow(b"new", tails, 10)) == [(b"new york", 15)]
