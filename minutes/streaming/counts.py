"""Counts of themes and topics over the tables of ``ingest``, kept up to date: a batch costs its own buckets.

What the speeches and bills of a bucket of meetings say of each theme is kept as small rows that can be merged. A meeting lies in
one bucket, so meetings, official speeches, bills and hits are sums. A name lies in many, so members are bitmaps over
ordinals of names, 32,768 of them a row. Ordinals are given once and never change: names deal themselves to slots by
their hash, and new ones are numbered on in their slot.

``count`` works out the buckets that a finished batch has replaced since it last ran, all others stay as they are. So a file
that comes in a new version counts as it is now; batches that were missed are made up for; and a run that is repeated
after a failure replaces what it had written. Counts are kept for each list of themes and topics apart.

Defined cases: no themes, no finished batch or empty tables give zeros; names and meetings that are null count for nothing.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import profile, themes
from ..sources.scratch import exists, stored
from . import ingest

Themes = list[tuple[str, list[str]]]
Topics = list[tuple[str, str]]
#: Stretches in which names are numbered, each by itself.
SLOTS = 256
_COUNTS = "kind string, label string, number long, bits binary, n long, batch int, bucket int"
_ORDINALS = "name string, ordinal long"


def place_of(out: str, wanted: Themes, topics: Topics) -> str:
    return f"{out}/counts/{hashlib.sha256(json.dumps([wanted, topics]).encode()).hexdigest()[:16]}"


def number_names(names: DataFrame, path: str) -> DataFrame:
    """All (name, ordinal) below ``path``, after those of ``names`` that it lacks were added behind the others of their slots."""
    spark = names.sparkSession
    known = spark.read.schema(_ORDINALS).parquet(path) if exists(spark, path) else spark.createDataFrame([], _ORDINALS)
    slot = F.pmod(F.xxhash64("name"), F.lit(SLOTS))
    used = known.groupBy(F.pmod(F.col("ordinal") - 1, F.lit(SLOTS)).alias("slot")).agg(F.max(F.floor((F.col("ordinal") - 1) / SLOTS) + 1).alias("used"))
    new = names.select("name").distinct().join(known, "name", "left_anti").withColumn("slot", slot)
    after = F.coalesce("used", F.lit(0)) + F.row_number().over(Window.partitionBy("slot").orderBy("name")) - 1
    new.join(F.broadcast(used), "slot", "left").select("name", (after * SLOTS + F.col("slot") + 1).cast("long").alias("ordinal")).write.mode("append").parquet(path)
    return spark.read.schema(_ORDINALS).parquet(path)


def _versions(spark: SparkSession, path: str) -> dict[int, tuple[int, int]]:
    """For each bucket the last run that counted it, and the version it was of."""
    if not exists(spark, f"{path}/counted"):
        return {}
    rows = spark.read.schema("bucket int, version int, batch int").parquet(f"{path}/counted").collect()  # a row for each run and bucket
    return {r["bucket"]: (r["batch"], r["version"]) for r in sorted(rows, key=lambda r: r["batch"])}


def partial_counts(speeches: DataFrame, agenda: DataFrame, wanted: Themes, topics: Topics, ordinals: str) -> DataFrame:
    """(kind, label, number, bits, n, bucket) of speeches and agenda with a column bucket."""
    folded = stored(themes.folded_themes(speeches, wanted, "norm", "bucket"), "folded")
    named = folded.where("name IS NOT NULL").select("bucket", "label", "name").distinct()
    placed = named.join(number_names(named, ordinals), "name")
    members = placed.groupBy("bucket", "label", F.bitmap_bucket_number("ordinal").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("ordinal")).alias("bits"))
    sums = folded.groupBy("bucket", "label").agg(F.count_distinct("meeting_id").alias("meetings"), F.sum("official").alias("official_hits"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("meetings", "official_hits"))))
    titles = themes.title_themes(agenda, wanted, "bucket").groupBy("bucket", "label").agg(F.count("*").alias("n"))
    hits = profile.topic_counts(speeches, topics, "bucket")
    row = lambda df, kind, number, bits, n: df.select(kind.alias("kind"), "label", number.cast("long").alias("number"), bits.cast("binary").alias("bits"), n.cast("long").alias("n"), "bucket")
    none = F.lit(None)
    summed = lambda df, kind: row(df, kind, none, none, F.col("n"))
    parts = [
        summed(sums.select("bucket", "label", each.alias("e")).select("bucket", "label", "e.*"), F.col("kind")),
        row(members, F.lit("members"), F.col("number"), F.col("bits"), none),
        summed(titles, F.lit("agenda_hits")), summed(hits.withColumnRenamed("hits", "n"), F.lit("topic")),
    ]
    return reduce(DataFrame.unionByName, parts)


def count(spark: SparkSession, out: str, wanted: Themes, topics: Topics = ()) -> list[int]:
    """Bring the counts of the tables below ``out`` up to date; the buckets that were worked out."""
    path = place_of(out, wanted, list(topics))
    now = {b: batch for batch, own in ingest.versions(spark, out).items() for b in own}
    counted = _versions(spark, path)
    stale = sorted(b for b, v in now.items() if counted.get(b, (None, None))[1] != v)
    if not stale:
        return []
    run = max((batch for batch, _ in counted.values()), default=-1) + 1
    tables = ingest.read_tables(spark, out, stale)
    made = partial_counts(tables["speeches"], tables["agenda"], wanted, list(topics), f"{path}/names")
    made.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts/batch={run}")
    spark.createDataFrame([(b, now[b]) for b in stale], "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/counted/batch={run}")
    return stale


def _current(spark: SparkSession, path: str) -> DataFrame:
    by_run: dict[int, list[int]] = {}
    for bucket, (run, _) in _versions(spark, path).items():
        by_run.setdefault(run, []).append(bucket)
    if not by_run:
        return spark.createDataFrame([], _COUNTS)
    here: Column = reduce(or_, ((F.col("batch") == r) & F.col("bucket").isin(own) for r, own in by_run.items()))
    return spark.read.schema(_COUNTS).parquet(f"{path}/counts").where(here)


def theme_scores(spark: SparkSession, out: str, wanted: Themes, topics: Topics = ()) -> DataFrame:
    """As ``themes.score_themes`` over all that was counted, from the kept rows alone."""
    rows = _current(spark, place_of(out, wanted, list(topics)))
    merged = rows.where("kind = 'members'").groupBy("label", "number").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    members = merged.groupBy("label").agg(F.sum("n").alias("members"))
    kinds = ("meetings", "official_hits", "agenda_hits")
    sums = rows.where(F.col("kind").isin(*kinds)).groupBy("label").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in kinds))
    every = themes.with_terms(spark, wanted)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(sums, "label", "left").join(members, "label", "left").select("label", "ord", *map(zero, ("meetings", "members", "official_hits", "agenda_hits")))


def topic_hits(spark: SparkSession, out: str, wanted: Themes, topics: Topics) -> DataFrame:
    """As ``profile.topic_hits``, from the kept rows alone."""
    rows = _current(spark, place_of(out, wanted, list(topics))).where("kind = 'topic'").groupBy("label").agg(F.sum("n").alias("hits"))
    every = spark.createDataFrame([(label,) for label, _ in topics], "label string")
    return every.join(rows, "label", "left").select("label", F.coalesce("hits", F.lit(0)).alias("hits"))
