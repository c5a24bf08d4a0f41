"""Saved queries as a table against the search of each of them."""

import random

import pytest
from pyspark.sql import functions as F

from minutes.operators import saved, search

GROWN = {"synonyms": [["ab", "cd"]], "readings": {"ee": "ca"}}
QUERIES = ["ab", "ab -c", "-a", "", None, "a", "bca OR dda", "ab cd OR -b e", "zz", "abc aabb", "ab OR ab", "ee", "OR", "平成7年", "b a -dd OR ca"]


def scores(rows):
    return sorted((r.query_id, repr(r.ord), r.score) for r in rows)


@pytest.mark.parametrize("part, in_place", [(saved.PART, saved.IN_PLACE), (saved.PART, 0), (7, 0)])
def test_against_each_search(spark, part, in_place):
    rng = random.Random(part)
    texts = [(i if i % 40 else None, "".join(rng.choices("abcde", [4, 3, 2, 1, 1], k=rng.randint(0, 14)))) for i in range(1, 240)] + [(7, None), (9, "平成七年abc平成7年"), (9, "ab")]
    rows = spark.createDataFrame(texts, "ord long, norm string").repartition(3)
    table = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(QUERIES)], "query_id string, query string")
    got = saved.search_saved(rows, table, ["ord"], dictionaries=GROWN, part=part, in_place=in_place)
    want = [r for i, q in enumerate(QUERIES) for r in search.search(rows, q or "", dictionaries=GROWN).select(F.lit(f"q{i}").alias("query_id"), "ord", "score").collect()]
    assert scores(got.collect()) == scores(want)
    assert scores(got.collect()) == scores(search.search_many(rows, [(f"q{i}", q or "") for i, q in enumerate(QUERIES)], ["ord"], dictionaries=GROWN).collect())
    assert saved.search_saved(rows.limit(0), table, ["ord"], in_place=in_place).collect() == [] and saved.search_saved(rows, table.limit(0), ["ord"], in_place=in_place).collect() == []


def test_texts_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "\0a"), (3, "a" * 300_000 + "bc")], "ord long, norm string")
    table = spark.createDataFrame([("x", "a"), ("y", "abc"), ("z", "aaa bc"), ("n", "-a")], "query_id string, query string")
    got = saved.search_saved(rows, table, ["ord"])
    assert scores(got.collect()) == [("x", "1", 1), ("x", "2", 1), ("x", "3", 300_000), ("y", "1", 1), ("y", "3", 1), ("z", "3", 100_001)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("in_place", [saved.IN_PLACE, 0])
def test_many_queries(spark, in_place):
    """A hundred thousand queries, of which few texts match any: the index leads to those alone."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choices(letters, k=200)) for _ in range(300)]
    table = spark.range(100_000).select(F.col("id").alias("query_id"), F.translate(F.lpad(F.conv("id", 10, 26), 4, "0"), "0123456789ABCDEFGHIJKLMNOP", letters).alias("query"))
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, norm string")
    got = {(r.query_id, r.ord): r.score for r in saved.search_saved(rows, table, ["ord"], in_place=in_place).collect()}
    place = lambda w: sum(letters.index(c) * 26**i for i, c in enumerate(reversed(w)))
    want = {}
    for i, t in enumerate(texts):
        for w in {t[j : j + 4] for j in range(len(t) - 3)}:
            if place(w) < 100_000:
                want[place(w), i] = t.count(w)
    assert got == want
