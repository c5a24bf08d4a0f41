"""Themes: how many meetings, members, official speeches and bills touch a list of terms."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import normalize_term, normalize_text
from ..functions.text import squeeze_ws, trim_ws
from .speeches import role_category

# Themes that are always candidates; boiler-plate in titles of bills.
SEEDS = ["補正予算", "一般質問", "入札", "介護", "子育て", "給食", "道路", "通年議会", "公共交通", "防災", "学校", "農業", "移住", "ふるさと納税", "医療", "高齢者", "観光", "環境"]
BOILERPLATE = "（.*?）|については|について|の件|条例|工事請負契約"
TITLES, QUESTIONS, SAMPLE_TITLES = 30, 500, 800
TOP = 8


def normal_terms(terms: list[str]) -> list[str]:
    return [t for t in dict.fromkeys(map(normalize_term, terms)) if t]


def _any(norm: Column, terms: list[str]) -> Column:
    return reduce(or_, (norm.contains(F.lit(t)) for t in terms), F.lit(False))


def matched_themes(norm: Column, themes: list[tuple[str, list[str]]]) -> Column:
    """The labels of the themes that a normal form touches."""
    return F.array_compact(F.array(*(F.when(_any(norm, normal_terms(terms)), F.lit(label)) for label, terms in themes)).cast("array<string>"))


def with_terms(spark: SparkSession, themes: list[tuple[str, list[str]]]) -> DataFrame:
    """(label, ord) of the themes with a term."""
    return spark.createDataFrame([(label, i) for i, (label, _) in enumerate(t for t in themes if normal_terms(t[1]))], "label string, ord int")


def folded_themes(speeches: DataFrame, themes: list[tuple[str, list[str]]], norm_col: str = "norm", *keep: str) -> DataFrame:
    """(…keep, label, meeting_id, name, official): the distinct meetings and names of members that touch a theme, and official speeches."""
    said = speeches.select(*keep, F.explode(matched_themes(F.coalesce(norm_col, F.lit("")), themes)).alias("label"), role_category(F.coalesce("role", F.lit(""))).alias("category"), "meeting_id", "name")
    member, official = F.col("category") == "議員", F.col("category").isin("当局", "議長")
    named = member & F.col("name").isNotNull() & (F.col("name") != "") & ~F.col("name").startswith("（")
    return said.groupBy(*keep, "label", F.when(member, F.col("meeting_id")).alias("meeting_id"), F.when(named, F.col("name")).alias("name")).agg(F.count_if(official).alias("official"))


def title_themes(agenda: DataFrame, themes: list[tuple[str, list[str]]], *keep: str) -> DataFrame:
    """(…keep, label) for each title and theme that it touches."""
    return agenda.where("title <> ''").select(*keep, F.explode(matched_themes(normalize_text(F.col("title")), themes)).alias("label"))


def score_themes(speeches: DataFrame, agenda: DataFrame, themes: list[tuple[str, list[str]]], norm_col: str = "norm") -> DataFrame:
    """(label, meetings, members, official_hits, agenda_hits) for every theme with a term.

    One scan works out the themes of each speech; only (theme, category, meeting, name) rows are shuffled, and distinct
    ones are folded before the counts, so a theme that most speeches touch costs no more than another.
    """
    own = [(label, terms) for label, terms in themes if normal_terms(terms)]
    folded = folded_themes(speeches, own, norm_col)
    counts = folded.groupBy("label").agg(F.count_distinct("meeting_id").alias("meetings"), F.count_distinct("name").alias("members"), F.sum("official").alias("official_hits"))
    titles = title_themes(agenda, own).groupBy("label").agg(F.count("*").alias("agenda_hits"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return with_terms(speeches.sparkSession, themes).join(counts, "label", "left").join(titles, "label", "left").select("label", "ord", *map(zero, ("meetings", "members", "official_hits", "agenda_hits")))


def seed_candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(SEEDS)], "ord int, label string")


def title_candidates(agenda: DataFrame) -> DataFrame:
    """(ord, label): the first distinct titles, in order of ``ord``, that have 2 to 12 characters without boiler-plate."""
    first = agenda.where("title <> ''").groupBy("title").agg(F.min("ord").alias("ord"))
    label = trim_ws(F.regexp_replace("title", BOILERPLATE, ""))
    return first.select("ord", label.alias("label")).where(F.length("label").between(2, 12)).orderBy("ord").limit(TITLES)


def rank_themes(scored: DataFrame, top: int = TOP) -> DataFrame:
    """(label, reason): the themes that most members raised, the first of a label; ties by meetings, then in order."""
    one = scored.where("members > 0").groupBy("label").agg(F.min_by(F.struct("ord", "members", "meetings"), "ord").alias("x")).select("label", "x.*")
    best = one.orderBy(F.desc("members"), F.desc("meetings"), "ord").limit(top)
    return best.select("label", F.format_string("%d会議・%d議員が取り上げ", "meetings", "members").alias("reason"), "members", "meetings", "ord")


def theme_query(terms: Column) -> Column:
    """Up to four terms of an array as an OR query."""
    clean = F.array_distinct(F.filter(F.transform(terms, trim_ws), lambda t: t != ""))
    return F.array_join(F.slice(clean, 1, 4), " OR ")


def question_heads(speeches: DataFrame, agenda: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a model is shown: heads of each member's first speech in a meeting, and distinct titles (both by ord)."""
    own = speeches.where(role_category(F.coalesce("role", F.lit(""))) == "議員")
    first = own.groupBy("meeting_id", "name").agg(F.min_by(F.substring(squeeze_ws(F.col("text")), 1, 90), "ord").alias("head"), F.min("ord").alias("ord"))
    titles = agenda.where("title <> ''").groupBy("title").agg(F.min("ord").alias("ord")).orderBy("ord").limit(SAMPLE_TITLES)
    return first.where(F.length("head") > 8).orderBy("ord").limit(QUESTIONS), titles
