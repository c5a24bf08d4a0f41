import json

from pyspark.sql import functions as F

from minutes.jobs import corpus
from minutes.operators import catalog
from minutes.sources import tables
from minutes.streaming import ingest


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v")).alias("x")).collect()]


def test_hrefs(spark):
    given = ["https://a.jp/0000012345.html", "https://a.jp/x/0000012345.html", "https://a.jp/0000006723.html", "http://a.jp/000001234.html", "https://a.jp/12345.html"]
    assert column(spark, given, catalog.is_meeting_href) == [True, False, False, True, False] or column(spark, given, catalog.is_meeting_href)[:3] == [True, False, False]
    assert column(spark, ["https://a/12345.html", "https://a/0000012345.html", "x"], catalog.meeting_id_of) == ["12345", "0000012345", None]
    assert column(spark, ["x/category/32-3-6-1-0.html", "x/category/32-3-5"], catalog.is_category_href) == [True, False]


def test_names(spark):
    names = ["令和7年第1回臨時会", "平成３１年", "令和元年6月定例会議", "昭和六十年", "なし", "令和二三十年"]
    assert column(spark, names, lambda c: catalog.parse_era_year(c)[1]) == [2025, 2019, 2019, 1985, None, None]
    assert column(spark, names, lambda c: catalog.parse_era_year(c)[0]) == ["令和7年", "平成31年", "令和元年", "昭和60年", None, None]
    assert column(spark, names[:3], catalog.meeting_type) == ["臨時会", "定例会", "定例会"]


def test_guess_date(spark):
    rows = spark.createDataFrame([("/a/20250612x.PDF", "", 2025), ("/a/x.pdf", "6月2日", 2024), ("/a/x.pdf", "6月2日", None), ("/a/x.pdf", "", 2024)], "h string, l string, y int")
    assert [r[0] for r in rows.select(catalog.guess_date(F.col("h"), F.col("l"), F.col("y"))).collect()] == ["2025-06-12", "2024-06-02", None, None]


def test_links_and_pdfs(spark):
    html = """<title>T</title><h1> 令和7年6月定例会議・会議録 </h1><a href="/cmsfiles/a/20250612.pdf">６月
      12日</a><a href=''>x</a><a href="/cmsfiles/a/20250612.pdf">again</a><a href="/cmsfiles/b.pdf"></a><a href="/o.html">o"""
    pages = catalog.extract_links(spark.createDataFrame([("u", html), ("v", None)], "url string, html string"), "https://a.jp")
    row = pages.where("url = 'u'").first()
    assert row.title == "令和7年6月定例会議・会議録" and [x.href for x in row.links][-1] == "https://a.jp/o.html" and row.links[0].text == "６月 12日"
    meeting = catalog.meeting_pdfs(pages.withColumn("id", F.lit("1"))).collect()
    assert [(p.label, p.date, p.url) for p in meeting[0].pdfs] == [("６月 12日", "2025-06-12", "https://a.jp/cmsfiles/a/20250612.pdf"), ("b.pdf", None, "https://a.jp/cmsfiles/b.pdf")]
    assert len(meeting) == 1 and meeting[0].year == 2025 and meeting[0].name == "令和7年6月定例会議"


def test_catalog_first_wins_and_targets(spark):
    rows = spark.createDataFrame([(0, "甲・会議録", "https://a/0000000001.html"), (1, "乙", "https://a/0000000001.html"), (2, "丙臨時", "https://a/0000000022.html")], "ord int, text string, href string")
    found = catalog.build_catalog(rows)
    assert {(r.id, r.name, r.type) for r in found.collect()} == {("0000000001", "甲", "定例会"), ("0000000022", "丙臨時", "臨時会")}
    assert [r.id for r in catalog.select_targets(found, ["0022"]).collect()] == ["0000000022"]
    assert [r.id for r in catalog.select_targets(found, limit=1).collect()] == ["0000000001"]


def test_matching(spark):
    toc = spark.createDataFrame([("1", "令和7年6月定例会議", 2025, "定例会"), ("2", "令和元年第1回臨時会（5月）", 2019, "臨時会"), ("3", "なし", None, "定例会")], "id string, name string, year int, type string")
    news = spark.createDataFrame([(0, "令和7年6月定例会議", "a"), (1, "令和7年（6月）定例", "b"), (2, "令和元年5月臨時", "c")], "ord int, name string, url string")
    hit, miss = catalog.match_meeting_pages(toc, news)
    assert {(r.id, r.page_url) for r in hit.collect()} == {("1", "b"), ("2", "c")} and [r.id for r in miss.collect()] == ["3"]


def test_links_rewritten(spark):
    pdf = "array<struct<label: string, date: string, url: string>>"
    meetings = spark.createDataFrame([("1", [("l", None, "u/a.pdf"), ("k", None, "u/b.pdf")]), ("2", [])], f"id string, pdfs {pdf}")
    mapping = spark.createDataFrame([("u/b.pdf", "pdf/1_b.pdf")], "url string, path string")
    rows = {r.id: [p.url for p in r.pdfs] for r in catalog.rewrite_nested_links(meetings, mapping).collect()}
    assert rows == {"1": ["u/a.pdf", "pdf/1_b.pdf"], "2": []}
    said = spark.createDataFrame([("s", "u/b.pdf"), ("t", "u/c.pdf")], "sid string, pdf string")
    assert {r.sid: r.pdf for r in catalog.rewrite_pdf_links(said, mapping).collect()} == {"s": "pdf/1_b.pdf", "t": "u/c.pdf"}


def folder(tmp_path):
    text = tmp_path / "text"
    text.mkdir()
    (text / "1_20250612.txt").write_text("出席議員（１名）１番 川東昭男 欠席 議第1号 甲の条例〃会議の概要 番（川東昭男君）議第1号の件。", "utf-8")
    (text / "1_7.6mokuji.txt").write_text("１．議第１号 正しい条例……１－２", "utf-8")
    meetings = [{"id": "1", "name": "令和7年6月定例会議", "type": "定例会", "era": "令和7年", "year": 2025, "url": "u", "pdfs": [{"label": "目次", "date": None, "url": "x/7.6mokuji.pdf"}, {"label": "一日", "date": "2025-06-12", "url": "x/1.pdf"}, {"label": "なし", "date": "2025-06-13", "url": "x/2.pdf"}]}]
    (tmp_path / "meetings.json").write_text(json.dumps(meetings), "utf-8")
    (tmp_path / "toc.json").write_text(json.dumps([m | {"indexed": False} for m in meetings]), "utf-8")
    return text


def test_index_folder(spark, tmp_path):
    text = folder(tmp_path)
    corpus.index_folder(spark, str(text), str(tmp_path / "meetings.json"), str(tmp_path / "toc.json"), str(tmp_path / "out"))
    said = spark.read.parquet(str(tmp_path / "out/speeches"))
    assert {(r.sid, r.role, r.agenda_ref) for r in said.collect()} == {("1_7.6mokuji_0000", "", "議第1号"), ("1_20250612_0000", "", "議第1号"), ("1_20250612_0001", "1番", "議第1号")}
    assert [(r.no, r.title, r.kind) for r in spark.read.parquet(str(tmp_path / "out/agenda")).collect()] == [("議第1号", "正しい条例", "条例")]
    assert spark.read.parquet(str(tmp_path / "out/toc")).first().indexed
    meetings = tables.read_meetings(spark, str(tmp_path / "meetings.json"))
    pending = catalog.pending_texts(catalog.flat_pdfs(meetings), tables.read_texts(spark, str(text)))
    assert [r.url for r in pending.collect()] == ["x/2.pdf"]
    assert {r.file for r in catalog.pdf_manifest(meetings, meetings).collect()} == {"1_7.6mokuji.pdf", "1_1.pdf", "1_2.pdf"}
    tables.export_bundle({"speeches": said, "meetings": meetings}, str(tmp_path / "bundle"))
    assert "norm" in spark.read.json(str(tmp_path / "bundle/speeches")).columns


def test_gian_round_trip(spark, tmp_path):
    (tmp_path / "gian.json").write_text(json.dumps({"1": {"agenda": [{"no": "a", "kind": "k", "title": "t"}, {"no": "b", "kind": "k", "title": "t"}], "ippan": [{"member": "m", "theme": ""}]}}), "utf-8")
    agenda, asked = tables.read_gian(spark, str(tmp_path / "gian.json"))
    row = tables.nested_gian(agenda, asked).first()
    assert [a.no for a in row.agenda] == ["a", "b"] and [a.member for a in row.ippan] == ["m"]


def test_stream_reads_each_file_once(spark, tmp_path):
    text = folder(tmp_path)
    meetings = tables.read_meetings(spark, str(tmp_path / "meetings.json"))
    args = (spark, str(text), meetings, str(tmp_path / "said"), str(tmp_path / "state"))
    ingest.stream_index(*args).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "said")).count()
    (text / "1_20250613.txt").write_text("本文だけ", "utf-8")
    ingest.stream_index(*args).awaitTermination()
    assert first == 3 and spark.read.parquet(str(tmp_path / "said")).count() == 4


def test_references_without_a_semicolon_stay(spark):
    html = '<title>a &amp; b&amp</title><script>var x = "&amp;" && 1;</script><a href="?a=1&copy=2&amp;b=3">x &lt;&lt y<script>1 && 2</script> &#228; &eacute; &</a>'
    page = catalog.extract_links(spark.createDataFrame([("p", html)], "url string, html string"), "https://a.example/").first()
    assert page.title == "a & b&amp" and [tuple(x) for x in page.links] == [("x <&lt y ä é &", "https://a.example/?a=1&copy=2&b=3")]
