import random

import pytest
from pyspark.sql import functions as F

from minutes.functions import normalize
from minutes.jobs import corpus
from minutes.operators import annotate, highlight, profile, search, themes, vectors, views

ROWS = [
    (0, "m1", "2025", "1番", "川東", "2025-06-12", "補正予算について。補正予算の補正"),
    (1, "m1", "2025", "町長", "堀", None, "かいがけの道路、令和７年の予算"),
    (2, "m2", "2024", "議長", "（本文）", "2024-01-01", "子供の給食とＳＮＳ"),
    (3, "m2", "2024", "2番", "西澤", "2024-01-02", ""),
]


@pytest.fixture
def said(spark):
    rows = spark.createDataFrame(ROWS, "ord int, meeting_id string, year string, role string, name string, date string, text string")
    return normalize.add_norm(rows.withColumn("type", F.lit("定例会")))


def found(df, query, **filters):
    return {r.ord: r.score for r in search.search(df, query, **filters).collect()}


def test_and_or_not(said):
    assert found(said, "道路 予算") == {1: 2}
    assert found(said, "道路 OR 給食") == {1: 1, 2: 1}
    assert found(said, "-予算") == {2: 0, 3: 0}
    assert found(said, "") == {0: 0, 1: 0, 2: 0, 3: 0}
    assert found(said, "予算 -道路") == {0: 2}
    assert found(said, "ー") == {} and set(found(said, "-ー")) == {0, 1, 2, 3}
    assert found(said, "- OR") == {0: 0, 1: 0, 2: 0, 3: 0}


def test_expansion(said):
    assert set(found(said, "R7")) == set(found(said, "2025")) == set(found(said, "令和七年")) == {1}
    own = {"synonyms": [["学童", "子供"], ["x", "y"]]}
    assert set(found(said, "学童", dictionaries=own)) == {2} and set(found(said, "sns")) == {2}
    assert search.expand_term("きょうと") == ["きょうと", "京都"] and search.expand_term("フォト") == ["フォト", "写真", "画像"]


@pytest.mark.parametrize(("text", "query", "score"), [("aaaa", "aa", 2), ("xx y", "x OR y", 2), ("写真写真", "フォト", 2), ("xxyy", "x y", 4)])
def test_hit_score(spark, text, query, score):
    rows = normalize.add_norm(spark.createDataFrame([(text,)], "text string"))
    assert rows.select(search.hit_score(F.col("norm"), search.compile_query(query))).first()[0] == score


def test_many_queries_by_automaton(said, monkeypatch):
    queries = [(q, q) for q in ("補正 OR 給食", "-予算", "予算 -道路", "", "ー", "- OR", "sns", "2025", "給食 -ー")]
    plain = sorted(map(tuple, search.search_many(said, queries, ["ord"]).collect()))
    monkeypatch.setattr(search, "INLINE_QUERIES", 1)
    assert sorted(map(tuple, search.search_many(said, queries, ["ord"]).collect())) == plain and len(plain) > 12


def test_filters(said):
    assert set(found(said, "", year=2024, role="議員")) == {3}
    assert set(found(said, "", speaker="町")) == {1}
    assert set(found(said, "", date_from="2024-01-02")) == {0, 3}
    assert set(found(said, "", meeting="m1", date_to="2025-12-31")) == {0}


def test_rank_page_summary(said):
    every = search.search(said, "予算 OR 給食")
    assert [r.ord for r in search.rank(every, "date").collect()] == [0, 2, 1]
    assert [r.ord for r in search.rank(every, "relevance").collect()] == [0, 2, 1]
    assert [r.ord for r in search.page(search.rank(every), 2, 2).collect()] == [1]
    assert tuple(search.search_summary(every).first()) == (3, 2, 4)
    assert search.page_count(every, 2).first()[0] == 2
    assert [r.ord for r in search.rank(search.after(every, "2025-06-12", 2, 0)).collect()] == [2, 1]


def test_search_page_job(said):
    summary, shown = corpus.search_page(said, "補正予算", order=["ord"], dictionaries={"synonyms": [["補正予算", "補正"]]})
    assert summary.first().n_rows == 1
    assert shown.first().snippet == "<mark>補正予算</mark>について。<mark>補正予算</mark>の<mark>補正</mark>"


def test_ranges_against_model():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choices("aabｂ髙高 ー・㍿株", k=rng.randint(0, 14)))
        alternatives = ["".join(rng.choices("ab高株", k=rng.randint(1, 2))) for _ in range(2)]
        norm, places = normalize.with_map(text)
        marked = set()
        for a in alternatives:
            at = norm.find(a)
            while at >= 0:
                marked.update(range(places[at], places[at + len(a) - 1] + 1))
                at = norm.find(a, at + len(a))
        spans = highlight.merged(text, alternatives, normalize.table(None))
        assert {i for s, e in spans for i in range(s, e)} == marked
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_snippets(spark):
    rows = spark.createDataFrame([("髙 橋さん",), ("x" * 100 + "髙橋" + "y" * 200,), ("z" * 250,), ("",)], "text string").coalesce(1)
    ranged = rows.withColumn("r", highlight.hit_ranges(F.col("text"), ["高橋"]))
    got = [r[0] for r in ranged.select(highlight.snippet(F.col("text"), F.col("r"))).collect()]
    assert got == ["<mark>髙 橋</mark>さん", "…" + "x" * 60 + "<mark>髙橋</mark>" + "y" * 170 + "…", "z" * 200 + "…", ""]
    assert ranged.select(highlight.highlight_full(F.col("text"), F.col("r"))).first()[0] == "<mark>髙 橋</mark>さん"


def test_themes(spark, said):
    agenda = spark.createDataFrame([("m1", 1, "補正予算の件"), ("m1", 2, "補正予算の件"), ("m1", 3, "給食条例")], "meeting_id string, ord int, title string")
    scored = {r.label: tuple(r)[2:] for r in themes.score_themes(said, agenda, [("予算", ["予算"]), ("給食", ["給食"]), ("無", ["ー"]), ("零", ["零"])]).collect()}
    assert scored == {"予算": (1, 1, 1, 2), "給食": (0, 0, 1, 1), "零": (0, 0, 0, 0)}
    rows = spark.createDataFrame([("a", 0, 0, 0), ("a", 1, 2, 5), ("b", 2, 2, 9), ("a", 3, 9, 9)], "label string, ord int, members long, meetings long")
    assert [(r.label, r.reason) for r in themes.rank_themes(rows).collect()] == [("b", "9会議・2議員が取り上げ"), ("a", "5会議・2議員が取り上げ")]
    assert [r.label for r in themes.title_candidates(agenda).collect()] == ["補正予算", "給食"]
    assert spark.range(1).select(themes.theme_query(F.array(*map(F.lit, [" a", "a", "", "b", "c", "d", "e"])))).first()[0] == "a OR b OR c OR d"
    heads, titles = themes.question_heads(said, agenda)
    assert [r["head"] for r in heads.collect()] == ["補正予算について。補正予算の補正"] and titles.count() == 2
    assert corpus.theme_ranking(said, agenda).first().label == "補正予算"


def test_profiles(spark, said):
    runs = spark.createDataFrame([("髙橋と髙橋、邊髙",)], "text string")
    assert [tuple(r) for r in profile.variant_candidates(runs, {"邊": "辺"}).collect()] == [("髙橋", 2), ("邊髙", 1)]
    assert [r.value for r in profile.speaker_list(said).collect()] == ["川東", "西澤", "町長"]
    assert {r.label: r.hits for r in profile.topic_hits(said, [("x", "予算 OR 給食"), ("y", "ＳＮＳ or 零")]).collect()} == {"x": 3, "y": 1}
    agenda = spark.createDataFrame([("議第1号", "その他", "件"), ("議第2号", "条例", "x")], "no string, kind string, title string")
    assert [r.bill for r in profile.unclassified_bills(agenda).collect()] == ["議第1号  件"]
    assert tuple(profile.profile_counts(said, agenda).first()) == (4, 2)


def test_vectors(spark, monkeypatch):
    rows = spark.createDataFrame([("a", [1.0, -1.0, -0.5 / 127, 0.5 / 127, 2.0])], "sid string, v array<double>")
    assert list(rows.select(vectors.quantize_int8(F.col("v"))).first()[0]) == [127, -127, 0, 1, 127]
    vecs = spark.createDataFrame([("a", [127, 0]), ("b", [0, 127]), ("c", [127, 0])], "sid string, vec array<tinyint>")
    assert [(r.sid, r.score) for r in vectors.vector_search(vecs, [1.0, 0.0], 2).collect()] == [("a", 1.0), ("c", 1.0)]
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query long, vec array<double>")
    many = vectors.vector_search_many(vecs, asked, 1).orderBy("query").collect()
    monkeypatch.setattr(vectors, "QUERIES", 1)
    assert vectors.vector_search_many(vecs, asked, 1).orderBy("query").collect() == many and vectors.vector_search_many(vecs, asked.limit(0)).count() == 0
    assert [(r["query"], r.sid, r["rank"]) for r in many] == [(0, "a", 1), (1, "b", 1)]


def test_annotations(spark, said):
    assert annotate.meeting_corpus(said, 20).where("meeting_id = 'm1'").first().corpus == "【1番 川東】補正予算について。補正予算"
    agenda = spark.createDataFrame([("m", 1, "n1", "x"), ("m", 2, "n1", "x"), ("m", 3, "n2", "x")], "meeting_id string, ord int, no string, kind string")
    given = spark.createDataFrame([("m", 0, "n1", "a"), ("m", 1, "n1", "b"), ("m", 2, "n2", "")], "meeting_id string, ord int, no string, kind string")
    assert [r.kind for r in annotate.apply_kind_overrides(agenda, given).orderBy("ord").collect()] == ["b", "x", "x"]


def test_views(spark):
    pdf = "array<struct<label: string, date: string, url: string>>"
    toc = spark.createDataFrame([("1", "n", 2025, "u", [("6月12日（PDFサイズ：1MB）.pdf", "2025-06-12", "p"), ("目次", None, "q")]), ("2", "n", 2025, "u", []), ("3", "n", None, "u", [])], f"id string, name string, year int, url string, pdfs {pdf}")
    rows = views.catalog_by_year(toc).collect()
    assert [(r.id, r.era_label, r.meetings_in_year) for r in rows] == [("2", "令和7年", 2), ("1", "令和7年", 2), ("3", None, 1)]
    assert [d.label for d in rows[1].days] == ["6月12日"]
