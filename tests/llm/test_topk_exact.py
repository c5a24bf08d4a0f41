"""Top-k with products that a double cannot tell apart, and with vectors far longer than the others."""

import random

import numpy as np
from pyspark.sql import functions as F

from minutes.llm import topk


def plain(rows, asks, k):
    out = []
    for name, q in rows:
        if asks(name):
            dot = lambda v: sum(a * b for a, b in zip(map(int, q), map(int, v), strict=False))  # noqa: B023, E731
            best = sorted((-dot(v), i) for i, v in rows if i != name)[:k]
            out += [(name, rank, i, -s if -(2**63) <= -s < 2**63 else None) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def got(spark, rows, is_query, k):
    table = topk.vectors(spark.createDataFrame(rows, "vec_id long, e array<double>").repartition(3), "vec_id", "e")
    return sorted(tuple(r) for r in topk.search(table, is_query, k).collect())


def test_products_that_differ_by_one(spark):
    """A query of norm near 2^26 and candidates of bound 2^53 whose products are n and n + 1: the greater one comes first."""
    for n in (0, 3, 6, 11):
        rows = [(0, [2.0**26, 1.0, 0.0]), (1, [2.0**26, float(n), 0.0]), (2, [2.0**26, float(n + 1), 0.0]), (3, [1.0, 2.0, 3.0]), (4, [0.0, 0.0, 94_906_265.0])]
        assert got(spark, rows, F.col("vec_id") == 0, 3) == plain(rows, lambda i: i == 0, 3)
        low = [(i, [x / 8 if abs(x) > 1e6 else x for x in v]) for i, v in rows]  # the longest that the index takes
        assert got(spark, low, F.col("vec_id") == 0, 3) == plain(low, lambda i: i == 0, 3)


def test_one_long_vector_does_no_harm(spark, monkeypatch):
    for name, n in (("LONG_QUERIES", 5), ("LONG_VECTORS", 40)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-200, 200, 6)]) for i in range(200)]
    rows += [(500, [float(np.float32(1e30)), -3.0, 0.0, 0.0, 0.0, 7.0]), (550, [2.0**30] * 6), (551, [-(2.0**40)] * 6), (552, [2.0**70, 1.0]), (600, [1e150, 0.0, 0.0, 0.0, 0.0, 0.0])]
    random.Random(2).shuffle(rows)
    assert got(spark, rows, F.col("vec_id") % 50 == 0, 5) == plain([(i, v + [0.0] * (6 - len(v))) for i, v in rows], lambda i: i % 50 == 0, 5)
    only = [r for r in rows if r[0] >= 500]
    assert got(spark, only, F.col("vec_id") % 50 == 0, 9) == plain([(i, v + [0.0] * (6 - len(v))) for i, v in only], lambda i: i % 50 == 0, 9)


def test_scaled(spark):
    values = [0.1, -0.1, 1e30, -1e300, 2.0**45 + 0.5, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(topk.scaled(F.col("x"))).collect()
    assert [int(r[0]) for r in rows] == [25, -26, int(1e30 * 256), int(-1e300 * 256), 2**53 + 128, 0]
