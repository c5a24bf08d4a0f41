"""Tables kept up to date batch by batch against tables built at once; one reading of the texts."""

import shutil

import pytest
from pyspark.sql import functions as F

from minutes.jobs import corpus
from minutes.operators import bills, extraction, speeches
from minutes.streaming import ingest

PDFS = "array<struct<label: string, date: string, url: string>>"
HEAD = "議事日程 出席議員（１名）１番 川東昭男 欠席 なし 日程 一般質問 １番 川東昭男君 2番 西澤 正治君 "
TEXTS = {
    "1_20250612": HEAD + "議第１号 補正予算 〃 議第2号 会議の概要 番（川東昭男君）議第1号について 町長（堀君） お答え",
    "1_20250613": HEAD + "議第2号 道路の認定 〃 報第3号 繰越計算書 〃 会議の概要 議長（山田君）再開",
    "1_7.6mokuji": "目次１．議第１号 令和の補正予算……１－２１．議第８号から議第９号まで（二件の条例）",
    "2_20250701": "２番 前田太郎君 一般質問 3番 福永晃仁君 議案第5号 財産の取得 〃 会議の概要",
    "3_20250801": "", "4_20250901": "本文だけ",
}


@pytest.fixture(scope="module")
def meetings(spark):
    pdf = lambda m, *days: [("本文", d, f"https://a/{m}{d}.pdf") for d in days]
    rows = [("1", "六月定例会", "定例会", 2025, "令和7年", [*pdf("1", "2025-06-12", "2025-06-13"), ("目次", None, "https://a/7.6mokuji.pdf")]), ("2", "七月", "臨時会", 2024, "令和6年", pdf("2", "2025-07-01")), ("3", "八月", "定例会", None, None, pdf("3", "2025-08-01")), ("4", "九月", "定例会", 2023, None, pdf("4", "2025-09-01"))]
    return spark.createDataFrame(rows, f"id string, name string, type string, year int, era string, pdfs {PDFS}")


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "text_key string, raw string")


def rows(tables):
    return {name: sorted(map(repr, (r.asDict() for r in df.select(sorted(set(df.columns) - {"norm"})).collect()))) for name, df in tables.items()}


def test_one_reading(spark, meetings):
    """The tagged rows give what each extractor gives alone, from one scan of the texts."""
    texts = frame(spark, TEXTS | {"1_20250613": None})
    got = extraction.extract(texts.repartition(2), meetings)
    assert got._jdf.queryExecution().executedPlan().toString().count("RoundRobinPartitioning") == 1
    for keys in (TEXTS, TEXTS | {"1_20250613": None}):
        made = corpus.build_tables(frame(spark, keys), meetings)
        files = frame(spark, keys).join(speeches_pdfs(meetings), "text_key")
        alone = speeches.build_index(frame(spark, keys).withColumn("meeting_id", F.lit("")), pdfs(meetings), meetings)
        toc = bills.extract_toc_titles(files.where("is_toc"))
        want = {"speeches": alone, "agenda": bills.build_agenda(bills.extract_bills(files), toc), "questioners": bills.merge_questioners(bills.extract_questioners(files))}
        assert rows(made) == rows(want)
        assert made["agenda"].count() > 3


def pdfs(meetings):
    from minutes.operators import catalog

    return catalog.flat_pdfs(meetings)


def speeches_pdfs(meetings):
    return pdfs(meetings).select("meeting_id", "pdf_pos", "is_toc", "text_key")


def test_three_batches_are_one(spark, meetings, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    names = list(TEXTS)
    want = rows(corpus.build_tables(frame(spark, TEXTS), meetings))
    batch = lambda n: frame(spark, {k: TEXTS[k] for k in names[n::3]})
    ingest.ingest(batch(0), 0, meetings, out, buckets=2)
    first = rows(ingest.read_tables(spark, out))
    # the second fails after its tables are half written: readers still see the first
    real = extraction.questioners_of
    monkeypatch.setattr(extraction, "questioners_of", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.ingest(batch(1), 1, meetings, out, buckets=2)
    monkeypatch.setattr(extraction, "questioners_of", real)
    assert rows(ingest.read_tables(spark, out)) == first
    for n in (1, 1, 2):
        ingest.ingest(batch(n), n, meetings, out, buckets=2)
    assert rows(ingest.read_tables(spark, out)) == want
    # a new version of a file that holds less, and one that holds nothing
    changed = TEXTS | {"1_20250613": "本文だけ", "2_20250701": ""}
    ingest.ingest(frame(spark, {k: changed[k] for k in ("1_20250613", "2_20250701")}), 3, meetings, out, buckets=2)
    want = rows(corpus.build_tables(frame(spark, changed), meetings))
    assert rows(ingest.read_tables(spark, out)) == want
    assert ingest.vacuum(spark, out) > 0 and rows(ingest.read_tables(spark, out)) == want
    said = ingest.read_tables(spark, out)["speeches"]
    assert said.where("year = 2023").select("norm").first().norm == "本文だけ" and "year" in said.where("year = 2023")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]


def test_stream_of_files(spark, meetings, tmp_path):
    folder, out = tmp_path / "texts", str(tmp_path / "out")
    folder.mkdir()
    run = lambda: ingest.stream_tables(spark, str(folder), meetings, out, str(tmp_path / "state"), buckets=3, files_per_batch=2).awaitTermination()
    for name in list(TEXTS)[:4]:
        (folder / f"{name}.txt").write_text(TEXTS[name], "utf-8")
    run()
    for name in list(TEXTS)[4:]:
        (folder / f"{name}.txt").write_text(TEXTS[name], "utf-8")
    run()
    run()
    assert rows(ingest.read_tables(spark, out)) == rows(corpus.build_tables(frame(spark, TEXTS), meetings))
    shutil.rmtree(folder)
