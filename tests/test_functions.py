import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from minutes.functions import eras, normalize
from minutes.functions.text import squeeze_ws, trim_ws


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v")).alias("x")).collect()]


def test_normalize_examples(spark):
    given = ["髙 橋", "議第４８号", "6,490万", "サーバー", "ＳＮＳ", "A～B", "ｶﾞ", "𠮷", None, "‐ｰ"]
    assert column(spark, given, normalize.normalize_text) == ["高橋", "議第48号", "6490万", "サバ", "sns", "a~b", "ガ", "吉", "", "‐ー"]


def test_normalize_against_model(spark):
    import unicodedata

    rng = random.Random(1)
    letters = "aÄßＡｶﾞ㍿①ー－ 　\t、・髙濵﨑İΣ𝐀～~〜-ｰ‐0０"
    given = ["".join(rng.choices(letters, k=rng.randint(0, 20))) for _ in range(300)]

    def slow(text):
        out = ""
        for c in text:
            if c in "、，,・･-－―ー~〜" or c in " \t　":
                continue
            out += unicodedata.normalize("NFKC", {"髙": "高", "濵": "浜", "﨑": "崎"}.get(c, c)).lower()
        return out

    assert column(spark, given, normalize.normalize_text) == [slow(t) for t in given]
    for t in given:
        norm, places = normalize.with_map(t)
        assert len(norm) == len(places) and norm == slow(t)
        assert all(slow(t[p]) for p in places)


def test_profile_normalize_is_whole_string(spark):
    assert column(spark, ["ｶﾞ ー", "髙"], normalize.profile_normalize) == ["ガ", "髙"]


def test_add_norm_keeps_what_is_there(spark):
    rows = spark.createDataFrame([("A B", "kept"), ("A B", None)], "text string, norm string")
    assert sorted(r.norm for r in normalize.add_norm(rows).collect()) == ["ab", "kept"]


@pytest.mark.parametrize(("year", "expected"), [(2025, ["2025", "令和7年", "令和7", "R7"]), (2019, ["2019", "令和元年", "令和元", "R1"]), (1989, ["1989", "平成元年", "平成元", "H1"]), (1900, ["1900"])])
def test_year_variants(spark, year, expected):
    assert column(spark, [year], eras.year_variants, "int") == [expected]
    assert eras.year_terms(str(year)) == expected


def test_expand_year(spark):
    given = ["令和七年", "r7", "２０２５年", "平成31", "0007", "令和", "昭和 六十四 年", "R元"]
    years = [2025, 2025, 2025, 2019, 7, None, 1989, 2019]
    assert column(spark, given, lambda c: eras.expand_year(c)["year"]) == years
    assert [int(t[0]) if (t := eras.year_terms(g)) else None for g in given] == years


def test_kanji_number(spark):
    given = ["十", "二十", "三十一", "三一", "元", "一2", "", "12", "二三十", "X"]
    assert column(spark, given, eras.kanji_number) == [10, 20, 31, 31, 1, None, None, 12, None, None]


def test_year_to_era(spark):
    assert column(spark, [2019, 2018, 1926, 1925, 2025], eras.year_to_era, "int") == ["令和元年", "平成30年", "昭和元年", "1925", "令和7年"]


def test_white_space(spark):
    assert column(spark, ["　a﻿", " a 　 b\n"], trim_ws) == ["a", "a 　 b"]
    assert column(spark, [" a 　\n b\n"], squeeze_ws) == ["a b"]


def test_normal_form_of_every_character(spark):
    """The JVM's branch and Python's agree with the table on all code points, alone and within a text."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for around in ("{}", "Ab -{}É", "Σ{}Σ "):
        given = [around.format(chr(c)) for c in codes] if around != "{}" else [chr(c) for c in codes]
        frame = spark.createDataFrame(pd.DataFrame({"t": given})).select("t", normalize.normalize_text(F.col("t")).alias("n"))
        assert not [r.t for r in frame.collect() if r.n != normalize.normalize_term(r.t)]


def test_latin_texts_stay_in_the_engine(spark):
    asked = lambda values, **more: [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(normalize.needs_python(F.col("v"), **more)).collect()]
    assert asked(["", None, "plain - ASCII\n\t~", "".join(map(chr, range(128))) * 50, "Ünïcode çà ß ÿ", "・", "½", "ＡＢ", "x" * 300_000]) == [False] * 5 + [True] * 3 + [False]
    assert asked(["abc", "xyz"], variants={"a": "b"}) == [True, False]
    assert column(spark, ["abc-A"], lambda c: normalize.normalize_text(c, {"a": "b"})) == ["bbca"]
