"""Tables behind the browsing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.eras import year_to_era
from ..functions.text import WS, trim_ws

# Fixed value: the note of a file's size in the text of a link.
SIZE_NOTE = f"[（(]{WS}*(?:PDF)?サイズ[：:][^）)]*[）)]"


def catalog_by_year(toc: DataFrame) -> DataFrame:
    """Meetings, newest year and largest id first, with the year's era and count and the links of their dated files."""
    counts = toc.groupBy("year").agg(F.count("*").alias("meetings_in_year"))
    label = lambda x: trim_ws(F.regexp_replace(F.regexp_replace(x["label"], SIZE_NOTE, ""), "(?i)^(.*?)\\.pdf", "$1"))
    days = F.transform(F.filter("pdfs", lambda x: x["date"].isNotNull()), lambda x: F.struct(label(x).alias("label"), x["date"].alias("date"), x["url"].alias("url")))
    rows = toc.join(counts, toc["year"].eqNullSafe(counts["year"])).drop(counts["year"])
    return rows.withColumn("era_label", year_to_era(F.col("year"))).withColumn("days", days).orderBy(F.coalesce("year", F.lit(0)).desc(), F.desc("id"))


def bills_by_meeting(meetings: DataFrame, agenda: DataFrame, questioners: DataFrame) -> DataFrame:
    """Meetings with any bill or questioner, with both lists in order and their sizes."""
    bills = agenda.groupBy(F.col("meeting_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "no", "kind", "title"))).alias("bills"))
    asked = questioners.groupBy(F.col("meeting_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "member"))).alias("questioners"))
    rows = meetings.join(bills.join(asked, "id", "full"), "id")
    return rows.withColumn("n_bills", F.coalesce(F.size("bills"), F.lit(0))).withColumn("n_questioners", F.coalesce(F.size("questioners"), F.lit(0)))


def corpus_header(speeches: DataFrame, toc: DataFrame) -> DataFrame:
    said = speeches.agg(F.count("*").alias("speeches"), F.count_distinct("meeting_id").alias("indexed"))
    return said.crossJoin(toc.agg(F.count("*").alias("catalogued")))


def meeting_link(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, link): a meeting's announcement (id, page_url) where there is one, else its own page."""
    return toc.select("id", "url").join(pages.select("id", "page_url"), "id", "left").select("id", F.coalesce("page_url", "url").alias("link"))
