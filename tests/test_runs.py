"""Ranges of hits from stored runs against those worked out from the text."""

import random

from pyspark.sql import functions as F

from minutes.functions.normalize import add_norm_runs
from minutes.operators import highlight


def test_same_ranges(spark):
    rng = random.Random(1)
    letters = "aab ー-㍿½ﬁİ髙𠮷。.*\\A 　"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(400)] + [None, "", " -", "aaaa", "㍿" * 3]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    kept = add_norm_runs(rows)
    for terms in (["a"], ["aa", "ab"], ["株式会社", "式"], ["1⁄2", "fi", "."], ["高", "吉a", "*"], ["\\"], ["i̇"], [], ["", "zz"], ["ba", "b", "a."]):
        both = kept.select("text", highlight.hit_ranges(F.col("text"), terms).alias("x"), highlight.stored_ranges(F.col("norm"), F.col("runs"), terms).alias("y")).collect()
        assert [(r.text, r.x) for r in both] == [(r.text, r.y) for r in both]


def test_no_python_behind_stored_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    add_norm_runs(spark.createDataFrame([(1, "補 正予算の補正")], "i int, text string")).write.parquet(path)
    own = spark.read.parquet(path)
    found = own.withColumn("ranges", highlight.stored_ranges(F.col("norm"), F.col("runs"), ["補正"]))
    shown = found.select(highlight.snippet(F.col("text"), F.col("ranges")).alias("s"), highlight.highlight_full(F.col("text"), F.col("ranges")).alias("f"))
    assert "Python" not in shown._jdf.queryExecution().executedPlan().toString()
    assert tuple(shown.first()) == ("<mark>補 正</mark>予算の<mark>補正</mark>",) * 2
