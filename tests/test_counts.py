"""Counts kept batch by batch against those of all tables at once."""

import random

import pytest
from pyspark.sql import functions as F

from minutes.functions import normalize
from minutes.operators import profile, themes
from minutes.streaming import counts, ingest

PDFS = "array<struct<label: string, date: string, url: string>>"
WANTED = [("budget", ["予算", "補正"]), ("road", ["道路"]), ("empty", [" "]), ("none", ["zz"]), ("all", ["に"])]
TOPICS = [("roads", "道路 OR ﾊﾞｽ"), ("none", "zz"), ("empty", "")]


def texts(n, seed):
    rng = random.Random(seed)
    line = lambda: rng.choice(["{0}番（{1}君）{2}について", "町長（堀君）{2}に", "議長（山田君）{2}"]).format(rng.randint(1, 9), rng.choice("甲乙丙丁戊己庚辛") + "野", rng.choice(["予算", "道路", "バス", "補正の道路"]))
    return {f"{i}_20250612": f"議事日程 議第{i}号 道路の補正 〃 会議の概要 " + " ".join(line() for _ in range(rng.randint(0, 6))) for i in range(1, n + 1)}


@pytest.fixture(scope="module")
def meetings(spark):
    rows = [(str(i), "定例会", "定例会", 2025, "令和7年", [("本文", "2025-06-12", f"https://a/{i}.pdf")]) for i in range(1, 25)]
    return spark.createDataFrame(rows, f"id string, name string, type string, year int, era string, pdfs {PDFS}")


def check(spark, out):
    now = ingest.read_tables(spark, out)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    got = counts.theme_scores(spark, out, WANTED, TOPICS)
    assert same(got, themes.score_themes(now["speeches"], now["agenda"], WANTED)), got.collect()
    assert same(counts.topic_hits(spark, out, WANTED, TOPICS), profile.topic_hits(now["speeches"], TOPICS))
    return {r.label: r.members for r in got.collect()}


def test_batches(spark, meetings, tmp_path, monkeypatch):
    out, every = str(tmp_path / "out"), texts(24, 1)
    names = list(every)
    frame = lambda keys, own=every: spark.createDataFrame([(k, own[k]) for k in keys], "text_key string, raw string")
    ingest.ingest(frame(names[:8]), 0, meetings, out, buckets=5)
    assert counts.count(spark, out, WANTED, TOPICS) and counts.count(spark, out, WANTED, TOPICS) == []
    check(spark, out)
    # two batches are made up for; the first attempt fails when its names are numbered and its rows are half written
    ingest.ingest(frame(names[8:16]), 1, meetings, out, buckets=5)
    ingest.ingest(frame(names[16:]), 2, meetings, out, buckets=5)
    before = [sorted(map(tuple, counts.theme_scores(spark, out, WANTED, TOPICS).collect()))]
    real = profile.topic_counts
    monkeypatch.setattr(profile, "topic_counts", lambda *a: real(*a).where(F.raise_error(F.lit("lost")).isNull()))
    with pytest.raises(Exception, match="lost"):
        counts.count(spark, out, WANTED, TOPICS)
    monkeypatch.setattr(profile, "topic_counts", real)
    assert sorted(map(tuple, counts.theme_scores(spark, out, WANTED, TOPICS).collect())) == before[0]
    counts.count(spark, out, WANTED, TOPICS)
    assert check(spark, out)["road"] > 3
    # one file in a new version that says nothing: its bucket alone is counted again
    ingest.ingest(frame(names[:1], {names[0]: ""}), 3, meetings, out, buckets=5)
    assert len(counts.count(spark, out, WANTED, TOPICS)) == 1
    check(spark, out)
    given = spark.read.parquet(f"{counts.place_of(out, WANTED, TOPICS)}/names")
    assert given.count() == given.select("name").distinct().count() == given.select("ordinal").distinct().count()


def test_names_keep_their_ordinals(spark, tmp_path):
    path = str(tmp_path / "names")
    own = lambda *r: spark.range(*r).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    first = {r.name: r.ordinal for r in counts.number_names(own(0, 3000), path).collect()}
    later = {r.name: r.ordinal for r in counts.number_names(own(2000, 50_000), path).collect()}
    assert len(later) == len(set(later.values())) == 50_000 and first.items() <= later.items()
    # numbers are dense: they take two bitmaps and what slots differ by
    assert max(later.values()) < 80_000 and min(later.values()) >= 1


def test_nothing_counted(spark, meetings, tmp_path):
    out = str(tmp_path / "out")
    ingest.ingest(spark.createDataFrame([], "text_key string, raw string"), 0, meetings, out, buckets=2)
    assert counts.count(spark, out, WANTED, TOPICS) == []
    assert {tuple(r)[2:] for r in counts.theme_scores(spark, out, WANTED, TOPICS).collect()} == {(0, 0, 0, 0)}
    assert {r.hits for r in counts.topic_hits(spark, out, WANTED, TOPICS).collect()} == {0}


def test_profile_form_in_the_engine(spark):
    """All of Latin-1 and some others, alone and within a text, as Python has them; texts in ASCII never reach Python."""
    chars = [chr(c) for c in range(1, 0x180)] + list("ｶﾞ①㍿　・ーΣ")
    rows = spark.createDataFrame([(t,) for c in chars for t in (c, f"Ab {c} ,Z")] + [(None,), ("",)], "text string")
    got = rows.select("text", normalize.profile_normalize(F.col("text")).alias("form")).collect()
    assert all(r.form == normalize.profile_term(r.text or "") for r in got), [r for r in got if r.form != normalize.profile_term(r.text or "")][:5]
