"""Fragments of the nested view, and whole bundles."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from minutes.functions.dictionaries import SYNONYMS, TOPICS, VARIANTS
from minutes.sources import tables

BILLS, ASKED = "meeting_id string, ord int, no string, kind string, title string", "meeting_id string, ord int, member string, theme string"


def test_fragments(spark, tmp_path):
    long = "長い題\n\"引用\" \\ ," + "x" * 1_000_000
    agenda = spark.createDataFrame([(f"m{i:03d}", k, f"議第{k}号", "条例", f"題{i}-{k}") for i in range(120) for k in (1, 2)] + [("m\"x,", 1, "報第1号", "報告", long)], BILLS)
    asked = spark.createDataFrame([("m000", 1, "甲", ""), ("m000", 2, "乙", "防災"), ("only", 1, "丙", "")], ASKED)
    path = str(tmp_path / "gian")
    tables.write_gian_fragments(agenda, asked, path, fragments=4)
    back = tables.read_gian_fragments(spark, path)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(back[0].select(agenda.columns)) == rows(agenda) and rows(back[1].select(asked.columns)) == rows(asked)
    # every file is a JSON object of its own, and they follow each other
    objects = [json.loads(f.read_text("utf-8")) for f in sorted(Path(path, "fragments").glob("part-*")) if f.stat().st_size]
    assert len(objects) > 1 and sum(map(len, objects)) == 122 and all(list(o) == sorted(o) for o in objects)
    spans = sorted((min(o), max(o)) for o in objects)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # noqa: RUF007, B905
    assert objects[0].keys() and {k for o in objects for k in o} == {*(f"m{i:03d}" for i in range(120)), "m\"x,", "only"}
    manifest = spark.read.json(f"{path}/manifest").collect()
    assert sorted((r["first"], r["last"], r.meetings) for r in manifest) == sorted((min(o), max(o), len(o)) for o in objects)
    one = tables.read_gian_fragments(spark, path, "m000")
    assert sorted(r.title for r in one[0].collect()) == ["題0-1", "題0-2"] and [r.member for r in one[1].orderBy("ord").collect()] == ["甲", "乙"]
    # the reader of one value reads fragments too
    assert rows(tables.read_gian(spark, f"{path}/fragments")[0].select(agenda.columns)) == rows(agenda)


def test_many_meetings_and_none(spark, tmp_path):
    agenda = spark.range(100_000).select(F.format_string("%06d", "id").alias("meeting_id"), F.lit(1).alias("ord"), F.lit("議第1号").alias("no"), F.lit("条例").alias("kind"), F.lit("題").alias("title"))
    none = spark.createDataFrame([], ASKED)
    tables.write_gian_fragments(agenda, none, str(tmp_path / "many"))
    back = tables.read_gian_fragments(spark, str(tmp_path / "many"))
    assert back[0].select("meeting_id").distinct().count() == 100_000 and back[1].count() == 0
    tables.write_gian_fragments(agenda.limit(0), none, str(tmp_path / "none"))
    assert tables.read_gian_fragments(spark, str(tmp_path / "none"))[0].count() == 0


def test_bundle(spark, tmp_path):
    path = str(tmp_path / "bundle")
    said = spark.createDataFrame([("s1", "髙橋です"), ("s2", None)], "sid string, text string")
    pages = spark.createDataFrame([("1", "https://a/1")], "id string, page_url string")
    gian = spark.createDataFrame([("1", 1, "議第1号", "条例", "題")], BILLS), spark.createDataFrame([("1", 1, "甲", "")], ASKED)
    tables.export_bundle({"speeches": said, "meeting_pages": pages}, path, gian, {"variants": VARIANTS, "synonyms": SYNONYMS, "topics": [{"label": a, "q": q} for a, q in TOPICS]})
    assert {(r.name, r.form) for r in spark.read.json(f"{path}/parts").collect()} == {("speeches", "lines"), ("meeting_pages", "lines"), ("gian", "fragments"), ("variants", "value"), ("synonyms", "value"), ("topics", "value")}
    assert {r.sid: r.norm for r in spark.read.json(f"{path}/speeches").collect()} == {"s1": "高橋です", "s2": ""}
    assert tables.read_small(spark, f"{path}/variants") == VARIANTS and tables.read_small(spark, f"{path}/synonyms") == SYNONYMS
    assert tables.read_gian_fragments(spark, f"{path}/gian", "1")[1].first().member == "甲"
