"""What a batch writes of speeches, and texts with a catalogue of many rows."""

from minutes.jobs import corpus
from minutes.operators import extraction, speeches
from minutes.sources import scratch
from minutes.streaming import ingest
from pyspark.sql import functions as F

DAYS = ("2025-06-12", "2025-06-13", "2025-06-14")
TEXTS = {f"1_{d.replace('-', '')}": f"議第{i}号 補正予算 〃 会議の概要 町長（堀君）{i}日目" for i, d in enumerate(DAYS)}


def catalogue(spark):
    pdfs = [*(("本文", d, f"https://a/{d}.pdf") for d in DAYS), ("目次", None, "https://a/7.6mokuji.pdf")]
    return spark.createDataFrame([("1", "六月定例会", "定例会", 2025, "令和7年", pdfs)], "id string, name string, type string, year int, era string, pdfs array<struct<label: string, date: string, url: string>>")


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "text_key string, raw string")


def test_speeches_are_added(spark, tmp_path, monkeypatch):
    """A batch writes its own speeches beside the others, until they lie in too many folders."""
    monkeypatch.setattr(ingest, "FOLDERS", 2, raising=False)
    out, meetings = str(tmp_path / "out"), catalogue(spark)
    dates = lambda df: sorted({r["date"] for r in df.select("date").collect()})
    written = []
    for n, key in enumerate(TEXTS):
        ingest.ingest(frame(spark, {key: TEXTS[key]}), n, meetings, out, buckets=1)
        written.append(dates(spark.read.parquet(f"{out}/speeches/batch={n}")))
        assert dates(ingest.read_tables(spark, out)["speeches"]) == list(DAYS[: n + 1])
    assert written == [[DAYS[0]], [DAYS[1]], list(DAYS)]
    ingest.vacuum(spark, out)
    got, want = ingest.read_tables(spark, out), corpus.build_tables(frame(spark, TEXTS), meetings)
    for name in ("speeches", "agenda"):
        assert sorted(map(repr, got[name].select(want[name].columns).collect())) == sorted(map(repr, want[name].collect()))


def test_catalogue_of_many_rows(spark, monkeypatch):
    """Texts are worked out where they lie and give the same rows; contents come from tables of contents alone."""
    line = "目次１．議第１号 令和の補正予算……１－２１．議第８号から議第９号まで（二件の条例）"
    texts, meetings = frame(spark, TEXTS | {"1_7.6mokuji": line, "1_20250614": line, "9_unknown": line}), catalogue(spark)
    want = sorted(map(repr, extraction.extract(texts, meetings).collect()))
    monkeypatch.setattr(scratch, "NARROW_ROWS", 0)
    got = extraction.extract(texts, meetings)
    assert sorted(map(repr, got.collect())) == want and sum("kind='contents'" in r for r in want) == 3
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("inline(")


def test_marks_are_read_backwards(spark):
    """A mark has a role of 1 to 16 characters before its name."""
    raw = spark.createDataFrame([("あ" * 20 + "（山田君）一　（堀君）二）（林君）三長（森君）",)], "raw string")
    found = raw.select(F.inline(speeches.speech_list(F.col("raw")))).collect()
    assert [(r.speech_pos, r.role, r.name, r.text) for r in found] == [(0, "", speeches.PREAMBLE, "ああああ"), (1, "あ" * 16, "山田", "一　（堀君）二）（林君）")]
