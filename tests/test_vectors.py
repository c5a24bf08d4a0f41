"""Nearest vectors of many queries against plain sorting."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from minutes.operators import vectors


def plain(stored, asked, k):
    out = []
    for name, q in asked:
        scored = sorted((-sum(x * y for x, y in zip(v, q, strict=True)), i) for i, v in stored if v is not None)
        out += [(name, i, round(-s), rank) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def frames(spark, stored, asked):
    return spark.createDataFrame(stored, "sid string, vec array<tinyint>").repartition(3), spark.createDataFrame(asked, "query long, vec array<tinyint>")


@pytest.mark.parametrize(("queries", "values", "chunk"), [(4096, 1 << 22, 1024), (7, 400, 16), (1, 64, 8)])
def test_many_queries(spark, monkeypatch, queries, values, chunk):
    for name, n in (("QUERIES", queries), ("VALUES", values), ("CHUNK", chunk)):
        monkeypatch.setattr(vectors, name, n)
    rng = random.Random(chunk)
    # few different components, so ties are everywhere; lengths differ much
    draw = lambda: [rng.choice([-1, 0, 1]) * rng.choice([1, 1, 1, 60]) for _ in range(4)]
    stored = [(f"s{i:03d}", draw()) for i in range(300)] + [("t", None)]
    asked = [(i, draw()) for i in range(40)] + [(99, [0, 0, 0, 0])]
    own, queries_ = frames(spark, stored, asked)
    got = vectors.vector_search_many(own, queries_, k=5)
    assert sorted((r.query, r.sid, round(r.score * 127), r["rank"]) for r in got.collect()) == plain(stored, asked, 5)
    assert vectors.vector_search_many(own, queries_.limit(0)).collect() == [] and vectors.vector_search_many(own.limit(0), queries_).collect() == []
    assert len(vectors.vector_search_many(own, queries_.limit(1), k=1000).collect()) == 300


def test_plan_does_not_grow_with_queries(spark):
    own, _ = frames(spark, [("a", [1, 2])], [(1, [1, 1])])
    size = lambda n: vectors.vector_search_many(own, spark.range(n).select(F.col("id").alias("query"), F.array(F.lit(1), F.lit(2)).cast("array<tinyint>").alias("vec")))._jdf.queryExecution().analyzed().toString().count("\n")
    assert size(10) == size(50_000)


def test_long_vectors_first_and_the_rest_left(monkeypatch):
    """Blocks behind the one whose scores no other can reach are not multiplied."""
    monkeypatch.setattr(vectors, "CHUNK", 10)
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (1000, 8)).astype(float)
    v[::100] = 100
    asked = pa.table([pa.array([0, 1]), pa.array([[1.0] * 8, [2.0] * 8])], ["query", "v"])
    stored = pa.table([pa.array(range(1000)), pa.array(v.tolist())], ["id", "v"])
    parted = []
    part = np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **k: parted.append(1) or part(*a, **k))
    names, ids, scores = vectors.nearest(asked, stored, 4)
    assert ids.to_pylist() == [0, 100, 200, 300] * 2 and names.to_pylist() == [0] * 4 + [1] * 4 and len(parted) == 1
