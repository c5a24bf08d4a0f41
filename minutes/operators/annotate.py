"""Annotations made elsewhere, and the texts they are made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

LONGEST = 60_000


def meeting_corpus(speeches: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(meeting_id, corpus): speeches in order as 【role name】text, a line each, cut at ``longest`` characters.

    Speeches beyond the cut are dropped by running length before anything is gathered, so a row is bounded.
    """
    line = F.concat(F.lit("【"), F.coalesce("role", F.lit("")), F.lit(" "), F.coalesce("name", F.lit("")), F.lit("】"), F.coalesce("text", F.lit("")))
    before = Window.partitionBy("meeting_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    kept = speeches.select("meeting_id", "ord", line.alias("line")).withColumn("__before", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))).where(F.col("__before") < longest)
    rows = kept.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("lines"))
    return rows.select("meeting_id", F.substring(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 1, longest).alias("corpus"))


def apply_kind_overrides(agenda: DataFrame, annotations: DataFrame) -> DataFrame:
    """The agenda (meeting_id, ord, no, kind, …) with kinds from (meeting_id, ord, no, kind): the last one that is not
    empty, for the first bill of its number."""
    given = annotations.where("kind <> ''").groupBy("meeting_id", "no").agg(F.max_by("kind", "ord").alias("__kind"))
    first = agenda.groupBy("meeting_id", "no").agg(F.min("ord").alias("ord"))
    named = first.join(given, ["meeting_id", "no"])
    out = agenda.join(named, ["meeting_id", "no", "ord"], "left").withColumn("kind", F.coalesce("__kind", "kind"))
    return out.select(*agenda.columns)


def apply_topics(speeches: DataFrame, annotations: DataFrame) -> DataFrame:
    """Speeches with the topics of their meeting (meeting_id, topics) where they have none."""
    given = annotations.select("meeting_id", F.col("topics").alias("__topics"))
    own = F.when(F.size("topics") > 0, F.col("topics")) if "topics" in speeches.columns else F.lit(None)
    return speeches.join(given, "meeting_id", "left").withColumn("topics", F.coalesce(own, "__topics")).drop("__topics")
