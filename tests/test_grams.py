"""Search through the index of grams against the search of everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from minutes.operators import grams, search

KANJI = [chr(c) for c in range(0x4E00, 0x4E00 + 600)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choices(KANJI + list("abc 。𠮷"), k=n))
    rows = [(i, f"m{i % 9}", 2020 + i % 3 if i % 50 else None, text(rng.randint(0, 60)), "町長") for i in range(3000)]
    rows[700] = (700, "m7", 2021, "ここに補正予算がある", "町長")
    rows[701] = (701, "m8", 2022, "平成七年の補 正予算", "町長")
    rows[702] = (702, "m8", None, "髙橋 道路", "町長")
    rows[703] = (703, "m8", 2022, None, "町長")
    return spark.createDataFrame(rows, "ord long, meeting_id string, year int, text string, role string").repartition(4)


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grams"))
    grams.build(corpus, path, ["ord"], block_bytes=2000)
    return path


QUERIES = ["補正予算", "補正予算 -平成", "補正", "道", "高橋", KANJI[5], KANJI[5] + KANJI[9], "ab", "a", "b OR 道路", "-a", "", "平成7年", "zzz", "zzz OR 補正予算", "a b c", "補正予算 zzz", "𠮷", "OR", "-zzz 高橋"]


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows(spark, corpus, index, query):
    rows = lambda df: sorted((r.ord, r.score) for r in df.select("ord", "score").collect())
    whole = search.search(corpus.withColumn("norm", F.lit(None).cast("string")).transform(grams.add_norm), query)
    assert rows(grams.search(spark, index, query)) == rows(whole)
    assert rows(grams.search(spark, index, query, year=2021)) == rows(whole.where("year = 2021"))


def test_a_rare_term_reads_few_blocks(spark, index):
    speeches = grams.read_blocks(spark, index)
    total = speeches.select("year", "block").distinct().count()
    lookup = grams.read_grams(spark, index)
    find = lambda q, **more: grams.candidate_blocks(lookup, search.compile_query(q), **more)
    assert total > 60
    for query in ("補正予算", "高橋 道路", "補正予算 OR 高橋"):
        assert 0 < len(find(query)) < total / 10
    assert find("zzz") == [] and find("-補正予算") is None and find("a") is None and find("補正予算 OR -a") is None
    assert find("補正予算", most=1) is None
    # folders that are ruled out are not read at all
    read = grams.search(spark, index, "補正予算 OR 高橋").select(F.input_file_name().alias("f")).distinct()
    plan = grams.search(spark, index, "補正予算")._jdf.queryExecution().executedPlan().toString()
    assert read.count() <= 3 and "block" in plan.split("PartitionFilters")[1].split("]")[0] and "Python" not in plan


def test_grams_do_not_cross_texts_and_hold_any_character():
    codes = np.concatenate([grams.code_points("ab"), [grams._BETWEEN], grams.code_points("\x00𠮷")])
    both = lambda a, b: (ord(a) << 21) | ord(b)
    assert sorted(grams.keys(codes, 2).tolist()) == sorted([both("a", "b"), both("\x00", "𠮷")]) and not len(grams.keys(codes[:2], 3))
    assert grams.term_keys("") == set() and grams.term_keys("a") == {97} and len(grams.term_keys("abcab")) == 3


def test_empty_table(spark, corpus, tmp_path):
    path = str(tmp_path / "none")
    grams.build(corpus.limit(0), path, ["ord"])
    assert grams.read_grams(spark, path).count() == 0 and grams.search(spark, path, "a").collect() == [] and grams.search(spark, path, "").collect() == []
