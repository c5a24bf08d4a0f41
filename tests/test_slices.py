"""Places of long and many texts, worked out a stretch at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from minutes.functions import normalize
from minutes.operators import highlight, search


def test_slices_are_bounded():
    texts = pa.array(["ab", None, "", "abcdefgh", "é", "x", "yz"])
    got = [s.to_pylist() for s in normalize.slices(texts, 4)]
    assert sum(got, []) == texts.to_pylist() and got == [["ab", None, ""], ["abcdefgh"], ["é", "x"], ["yz"]]
    assert list(normalize.slices(texts.slice(0, 0))) == [] and [s.to_pylist() for s in normalize.slices(texts.slice(3), 4)][0] == ["abcdefgh"]


def test_many_hits_of_a_long_text(spark):
    """Work in the square of 40,000 hits would take minutes."""
    rows = normalize.add_norm_runs(spark.createDataFrame([(1, "the - x" * 40_000), (2, "the" * 40_000), (3, None)], "i int, text string"))
    both = rows.select("i", highlight.stored_ranges(F.col("norm"), F.col("runs"), ["the"]).alias("x"), highlight.hit_ranges(F.col("text"), ["the"]).alias("y"), "text")
    got = both.select("i", (F.col("x") == F.col("y")).alias("same"), F.size("x").alias("n"), F.length(highlight.highlight_full(F.col("text"), F.col("x"))).alias("m")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, True, 40_000, 20 * 40_000), (2, True, 1, 120_013), (3, True, 0, None)]


def test_map_is_whole_beyond_a_slice(spark):
    n = normalize.SLICE // 1000
    rows = spark.range(0, n * 2, 1, 1).select(F.expr("repeat('a b', 400)").alias("t")).select(normalize.normalize_with_map(F.col("t")).alias("x"))
    assert tuple(rows.agg(F.count("*"), F.sum(F.size("x.map")), F.sum(F.element_at("x.map", -1))).first()) == (2 * n, 2 * n * 800, 2 * n * 1199)


def test_matches_are_handed_on_in_parts(spark):
    rows = spark.range(0, 500, 1, 1).select("id", F.lit("abc").alias("norm"))
    found = search.search_many(rows, [(f"q{i}", "ab") for i in range(300)], ["id"])
    assert 500 * 300 > search.MATCHES and found.distinct().count() == found.count() == 500 * 300


def test_marks_of_many_hits(spark):
    """Snippets through the map, where every cut from the start of the text would take minutes."""
    row = spark.createDataFrame([("é" * 300 + "the 髙 " * 30_000,)], "text string").withColumn("r", highlight.hit_ranges(F.col("text"), ["the"]))
    shown = row.select(highlight.snippet(F.col("text"), F.col("r"))).first()[0]
    assert shown == "…" + "é" * 60 + "<mark>the</mark> 髙 " * 30_000
