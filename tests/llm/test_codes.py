"""Vector codes against plain Lloyd rounds in Python's integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from minutes.llm import codes


def plain(rows, parts, entries, rounds, scale=256):
    """rows: (id, vector, label) of vectors that take part, in any order."""
    if not rows:
        return set()
    each = max(1, -(-len(rows[0][1]) // parts))
    whole = [(i, [math.floor(float(x) * scale) for x in v] + [0] * (each * parts - len(v)), label) for i, v, label in rows]
    cut = [[v[p * each : (p + 1) * each] for p in range(parts)] for _, v, _ in whole]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, [float(x) for x in rows[k][1]]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (gap(x, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for c in cut:
                own[near(c[p], book)].append(c[p])
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e], strict=True)] if own[e] else y for e, y in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    made = [(i, [near(c[p], books[p]) for p in range(parts)], label, c) for (i, _, label), c in zip(whole, cut, strict=True)]
    error = [sum(gap(c[p], books[p][e]) for p, e in enumerate(code)) for _, code, _, c in made]
    fits = lambda x: x if x <= codes.LONGEST else None
    by = defaultdict(list)
    for (_, _, label, _), x in zip(made, error, strict=True):
        by[label].append(fits(x))
    total = {k: None if None in v else fits(sum(v)) for k, v in by.items()}
    return sorted((repr(i), "".join(f"{e:02x}" for e in code), fits(x), total[label], digest) for (i, code, label, _), x in zip(made, error, strict=True))


def table(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(i, v, label, 7, "x") for i, v, label in rows], f"vec_id long, embedding {kind}, label int, id int, code string")


def got(df):
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_against_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 100)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 12))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + rng.standard_normal(12) / 5], None if i % 7 == 0 else int(i % 3)) for i in range(700)]
    rows += rows[5:9] + [(None, rows[3][1], 1)]  # repeated rows, a null id
    random.Random(1).shuffle(rows)
    assert got(codes.compress(table(spark, rows).repartition(3), parts=4, entries=16, rounds=2)) == plain(rows, 4, 16, 2)
    # every tie there is: components of three values only
    ties = [(i, [float(x) / 256 for x in rng.integers(-1, 2, 8)], 0) for i in range(600)]
    assert got(codes.compress(table(spark, ties).repartition(2), parts=4, entries=32, rounds=3)) == plain(ties, 4, 32, 3)


def test_left_out_and_few(spark):
    bad = [(100, None, 1), (101, [1.0, None], 1), (102, [1.0, math.nan], 1), (103, [math.inf, 1.0], 1), (104, [1.0], 1), (105, [], None)]
    rows = [(3, [0.5, -0.001], 1), (1, [0.25, 0.75], None), (2, [0.25, 0.75], None)]
    assert got(codes.compress(table(spark, rows + bad), parts=2, entries=64)) == plain(rows, 2, 64, 2)
    # parts that do not divide the length, and more parts than components
    assert got(codes.compress(table(spark, rows), parts=4, entries=2)) == plain(rows, 4, 2, 2)
    assert codes.compress(table(spark, []), parts=2).collect() == [] and codes.compress(table(spark, bad[:4]), parts=2).collect() == []
    with pytest.raises(ValueError):
        codes.compress(table(spark, rows), entries=257)


def test_large_components_are_exact(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 50)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(4)], i % 2) for i in range(120)]
    rows += [(200 + i, [float(np.float32(x)) for x in rng.standard_normal(4) * 1e30], 1) for i in range(5)] + [(3, [1e38, -3e38, 0.0, 2.0], 5), (300, [2.0**40, 1.0, 0.0, 0.0], 6)]
    assert got(codes.compress(table(spark, rows, "array<double>").repartition(2), parts=2, entries=8)) == plain(rows, 2, 8, 2)


def test_boxes_rule_out_without_visiting(spark):
    """Whole subtrees are assigned at once where clusters are far apart."""
    rng = np.random.default_rng(1)
    points = (rng.integers(0, 8, 4000)[:, None] * 1000 + rng.integers(-20, 20, (4000, 4))).astype(float)
    order = codes.tree_order(points)
    tree = codes.Tree.of(codes.exact(points[order], codes.bound(4)))
    entries = np.arange(8)[:, None] * 1000 + np.zeros((1, 4), np.int64)
    seen = []
    keep = codes.filtered
    codes.filtered = lambda lo, hi, e, live: seen.append(len(lo)) or keep(lo, hi, e, live)
    try:
        total, count = codes.assign(tree, entries)
    finally:
        codes.filtered = keep
    assert count.sum() == 4000 and (total.sum(0) == tree.total[0][0]).all()
    assert sum(seen) < 200  # of 1023 nodes
