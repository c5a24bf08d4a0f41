"""Corpus profiles for the upkeep of dictionaries."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import profile_normalize, profile_term
from ..functions.text import to_half_digits
from .bills import OTHER
from .speeches import MEMBER_ROLE

# Characters that are variants if they occur, and what makes a run of kanji.
WATCHED = "髙﨑𠮷德濵濱邊邉齋齊靑𥔎曽渕栁嶋舘槇彅晄兒緖賴圡𡈽塚祐"
KANJI_RUN = "[一-龥々〆ヶ]{1,12}"


def unclassified_bills(agenda: DataFrame) -> DataFrame:
    return agenda.where(F.col("kind") == OTHER).select(F.concat_ws("  ", "no", "title").alias("bill"))


def variant_candidates(speeches: DataFrame, variants: dict[str, str], watched: str = WATCHED) -> DataFrame:
    """(run, n): kanji runs with a watched character that the dictionary lacks, once for each such character."""
    missing = "".join(c for c in watched if c not in variants)
    runs = speeches.select(F.explode(F.regexp_extract_all("text", F.lit(KANJI_RUN), F.lit(0))).alias("run"))
    n = F.length("run") - F.length(F.translate("run", missing, ""))
    return runs.withColumn("__n", n).where("__n > 0").groupBy("run").agg(F.sum("__n").alias("n")).orderBy(F.desc("n"), "run")


def speaker_master(speeches: DataFrame, last: bool = False) -> DataFrame:
    """(kind, name, role): members by name and officials by role, with their first (or last) counterpart in order of
    ``ord``, by map-side aggregation: the chair has most of the rows."""
    named = speeches.where((F.col("name") != "") & ~F.col("name").startswith("（") & (F.col("role") != ""))
    member = F.col("role").rlike(MEMBER_ROLE)
    pick = F.max_by if last else F.min_by
    kinds = named.select(F.when(member, "member").otherwise("official").alias("kind"), F.when(member, F.col("name")).otherwise(F.col("role")).alias("value"), F.when(member, F.col("role")).otherwise(F.col("name")).alias("hint"), "ord")
    return kinds.groupBy("kind", "value").agg(pick("hint", "ord").alias("hint"), F.min("ord").alias("first_ord"))


def speaker_list(speeches: DataFrame) -> DataFrame:
    """Speakers for a search list: members by seat (without a number last), then officials in dictionary order."""
    seat = F.coalesce(F.nullif(F.regexp_extract(to_half_digits(F.col("hint")), "^([0-9]+)", 1).try_cast("int"), F.lit(0)), F.lit(999))
    master = speaker_master(speeches)
    is_member = F.col("kind") == "member"
    return master.orderBy(F.when(is_member, 0).otherwise(1), F.when(is_member, seat), F.when(is_member, F.col("first_ord")), F.collate("value", "ja"))


def topic_hits(speeches: DataFrame, topics: list[tuple[str, str]]) -> DataFrame:
    """(label, hits): speeches whose profile form holds any part of the topic's OR query."""
    return topic_counts(speeches, topics)


def topic_counts(speeches: DataFrame, topics: list[tuple[str, str]], *keep: str) -> DataFrame:
    """The same for each combination of the columns ``keep``; a column form is taken as the profile form."""
    parts = [(label, [p for p in map(profile_term, re.split(r"\s+[Oo][Rr]\s+", q)) if p]) for label, q in topics]

    def holds(text: Column, terms: list[str]) -> Column:
        return reduce(or_, (text.contains(F.lit(t)) for t in terms), F.lit(False))

    form = F.coalesce("form", F.lit("")) if "form" in speeches.columns else profile_normalize(F.col("text"))
    rows = speeches.select(*keep, form.alias("form"))
    counts = rows.groupBy(*keep).agg(F.count("*").alias("c"), *(F.count_if(holds(F.col("form"), terms)).alias(f"c{i}") for i, (_, terms) in enumerate(parts)))
    each = F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"c{i}").alias("hits")) for i, (label, _) in enumerate(parts))).cast("array<struct<label: string, hits: bigint>>")
    return counts.select(*keep, F.explode(each).alias("r")).select(*keep, "r.*")


def profile_counts(speeches: DataFrame, agenda: DataFrame) -> DataFrame:
    return speeches.agg(F.count("*").alias("speeches")).crossJoin(agenda.agg(F.count("*").alias("bills")))
