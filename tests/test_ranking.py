"""BM25 and fused rankings against plain arithmetic."""

import math
import random

import pytest

from minutes.operators import ranking


def test_bm25(spark):
    rng = random.Random(1)
    norms = ["".join(rng.choices("abcde", k=rng.randint(0, 40))) for _ in range(200)] + [None, "", "zz"]
    terms = [["ab", "ba"], ["c"], ["zz"], ["never"]]
    said = spark.createDataFrame(list(enumerate(norms)), "sid long, norm string").repartition(3)
    texts = [n or "" for n in norms]
    tf = [[next((t.count(a) for a in term if a in t), 0) for term in terms] for t in texts]
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    df = [sum(x[i] > 0 for x in tf) for i in range(len(terms))]
    want = {i: sum(math.log(1 + (n - df[j] + 0.5) / (df[j] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(texts[i]) / mean)) for j, f in enumerate(row) if f) for i, row in enumerate(tf) if any(row)}
    got = {r.sid: r.bm25 for r in ranking.bm25(said, terms).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    order = sorted(want, key=lambda i: (-want[i], i))[:7]
    best = ranking.top(ranking.bm25(said, terms), "sid", "bm25", 7).orderBy("rank").collect()
    assert [(r.sid, r["rank"]) for r in best] == [(i, k) for k, i in enumerate(order, 1)]
    assert ranking.bm25(said, []).collect() == [] and ranking.bm25(said.limit(0), terms).collect() == []
    assert "Python" not in ranking.bm25(said, terms)._jdf.queryExecution().executedPlan().toString()


def test_terms():
    assert ranking.query_terms("予算 -道路 OR 予算 写真") == [["予算"], ["写真", "フォト", "画像"]]
    assert ranking.gram_terms("給食 費の") == [["給食"], ["食費"], ["費の"]] and ranking.gram_terms("費") == [["費"]] and ranking.gram_terms("") == []


@pytest.mark.parametrize("by", [(), ("q",)])
def test_fusion(spark, by):
    ranks = {"word": {"a": 1, "b": 2, "c": 3}, "vector": {"c": 1, "d": 2, "b": 3}}
    frames = {name: spark.createDataFrame([(q, i, r) for q in (1, 2)[: 1 + len(by)] for i, r in own.items()], "q int, sid string, rank int") for name, own in ranks.items()}
    got = ranking.fuse(frames, "sid", 3, by=by).collect()
    # c: 1/63 + 1/61, b: 1/62 + 1/63, then a with 1/61
    assert sorted((r["rank"], r.sid, r.rank_word, r.rank_vector) for r in got) == sorted([(1, "c", 3, 1), (2, "b", 2, 3), (3, "a", 1, None)] * (1 + len(by)))
    tied = {"word": spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, sid string, rank int"), "vector": spark.createDataFrame([(1, "y", 1), (1, "x", 2)], "q int, sid string, rank int")}
    assert [(r.sid, r["rank"]) for r in ranking.fuse(tied, "sid", 2, by=by).orderBy("rank").collect()] == [("x", 1), ("y", 2)]


def test_hybrid(spark):
    said = spark.createDataFrame([("a", "予算と道路"), ("b", "道路"), ("c", "")], "sid string, norm string")
    near = spark.createDataFrame([("c", 1), ("a", 2)], "sid string, rank int")
    assert [r.sid for r in ranking.hybrid(said, [["予算"], ["道路"]], near).orderBy("rank").collect()] == ["a", "c", "b"]
