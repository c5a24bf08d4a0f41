"""Readers and writers of the corpus tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.dictionaries import load as read_dicts
from ..functions.normalize import add_norm

__all__ = ["read_dicts", "read_gian", "read_meetings", "read_summaries", "read_texts", "read_toc"]


def key_of_file(name: Column) -> tuple[Column, Column]:
    """(meeting_id, text_key) of a text file's name, which may come with its special characters escaped."""
    plain = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    key = F.regexp_replace(plain, "\\.txt\\z", "")
    return F.substring_index(key, "_", 1), key


def read_texts(spark: SparkSession, folder: str, partitions: int | None = None) -> DataFrame:
    """One row per text file below ``folder``: meeting_id, text_key, raw. Files are small; ``partitions`` spreads them."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_name").alias("file"))
    meeting, key = key_of_file(F.col("file"))
    rows = files.select(meeting.alias("meeting_id"), key.alias("text_key"), F.col("value").alias("raw"))
    return rows.repartition(partitions) if partitions else rows


def read_meetings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MEETINGS).option("multiLine", True).json(path)


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TOC).option("multiLine", True).json(path)


def _mapping(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("meeting_id", "x"))


def read_gian(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(agenda, questioners) from one JSON object by meeting."""
    return _flat_gian(_mapping(spark, path, schemas.GIAN))


def read_summaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(topics by meeting, kinds by meeting and number) from annotations."""
    rows = _mapping(spark, path, schemas.SUMMARIES)
    kinds = rows.select("meeting_id", F.posexplode("x.gian").alias("ord", "a")).select("meeting_id", "ord", "a.no", "a.kind")
    return rows.select("meeting_id", "x.summary", "x.topics"), kinds


def nested_gian(agenda: DataFrame, questioners: DataFrame) -> DataFrame:
    """One row per meeting: its bills and its questioners as lists in order."""
    strip = lambda c, *names: F.transform(F.array_sort(c), lambda x: F.struct(*(x[n].alias(n) for n in names)))
    bills = agenda.groupBy("meeting_id").agg(strip(F.collect_list(F.struct("ord", "no", "kind", "title")), "no", "kind", "title").alias("agenda"))
    asked = questioners.groupBy("meeting_id").agg(strip(F.collect_list(F.struct("ord", "member", "theme")), "member", "theme").alias("ippan"))
    return bills.join(asked, "meeting_id", "full")


def write_gian(agenda: DataFrame, questioners: DataFrame, path: str) -> None:
    """The nested view as one JSON object by meeting. It is one value, as its readers want it: for bundles of one body."""
    entry = F.struct(F.coalesce("agenda", F.array().cast(schemas.BILL_LIST)).alias("agenda"), F.coalesce("ippan", F.array().cast(schemas.ASKED_LIST)).alias("ippan"))
    whole = nested_gian(agenda, questioners).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("meeting_id", entry.alias("x")))))).alias("value"))
    whole.write.mode("overwrite").text(path)


def write_gian_fragments(agenda: DataFrame, questioners: DataFrame, path: str, fragments: int | None = None) -> None:
    """The nested view in fragments sorted by meeting, for any number of meetings: every file below ``path``/fragments is a
    JSON object by meeting, with one meeting a line, and ``path``/manifest tells which meetings each file has.

    A task writes the meetings of a range, one after the other, so no task holds more than a batch of them. Fragments are
    as many as the size takes, unless a number is given.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            # a comma before all but the first, and the braces on lines of their own
            made = [f",{x}" for x in batch.column("value").to_pylist()]
            if made and not begun:
                begun, made = True, ["{", made[0][1:], *made[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array(["}"])], ["value"])

    entry = F.struct(F.coalesce("agenda", F.array().cast(schemas.BILL_LIST)).alias("agenda"), F.coalesce("ippan", F.array().cast(schemas.ASKED_LIST)).alias("ippan"))
    one = F.to_json(F.create_map(F.coalesce("meeting_id", F.lit("")), entry))
    nested = nested_gian(agenda, questioners)
    rows = nested.repartitionByRange(*([fragments] if fragments else []), "meeting_id").sortWithinPartitions("meeting_id")
    inside = F.substring(one, F.lit(2), F.length(one) - 2)
    rows.select(inside.alias("value")).mapInArrow(lines, "value string").write.mode("overwrite").text(f"{path}/fragments")
    found = _fragment_lines(agenda.sparkSession, path).groupBy("file").agg(F.min("meeting_id").alias("first"), F.max("meeting_id").alias("last"), F.count("*").alias("meetings"))
    found.repartitionByRange("first").sortWithinPartitions("first").write.mode("overwrite").json(f"{path}/manifest")


def _fragment_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, meeting_id, x) of fragments, a line at a time."""
    kept = spark.read.schema("value string").text(f"{path}/fragments").where(F.length("value") > 1)
    whole = F.concat(F.lit("{"), F.regexp_replace("value", "^,", ""), F.lit("}"))
    return kept.select(F.col("_metadata.file_name").alias("file"), F.explode(F.from_json(whole, schemas.GIAN)).alias("meeting_id", "x"))


def _flat_gian(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(agenda, questioners) of rows (meeting_id, x)."""
    flat = lambda c: rows.select("meeting_id", F.posexplode(f"x.{c}").alias("pos", "a")).select("meeting_id", (F.col("pos") + 1).alias("ord"), "a.*")
    return flat("agenda"), flat("ippan")


def read_gian_fragments(spark: SparkSession, path: str, meeting: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(agenda, questioners) of fragments; of one meeting, from the fragments that may have it alone."""
    rows = _fragment_lines(spark, path)
    if meeting is not None:
        manifest = spark.read.schema("file string, first string, last string, meetings long").json(f"{path}/manifest")
        files = [r["file"] for r in manifest.where((F.col("first") <= meeting) & (F.col("last") >= meeting)).collect()]  # one or two
        rows = rows.where(F.col("file").isin(files) & (F.col("meeting_id") == meeting))
    return _flat_gian(rows)


def write_typed(df: DataFrame, path: str, kind: str) -> None:
    """A table of ``schemas.TYPED``: its columns, in its order and of its types, and no others."""
    fields = StructType.fromDDL(schemas.TYPED[kind])
    df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)).write.mode("overwrite").parquet(path)


def read_typed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(schemas.TYPED[kind]).parquet(path)


def write_speeches(speeches: DataFrame, path: str, with_norm: bool = False, dynamic: bool = False) -> None:
    """The table of speeches by year; with ``dynamic`` only the years at hand are replaced."""
    own = add_norm(speeches) if with_norm else speeches.drop("norm")
    mode = {"partitionOverwriteMode": "dynamic"} if dynamic else {}
    # partitions of a year are as many as its size takes
    own.hint("rebalance", "year").write.mode("overwrite").options(**mode).partitionBy("year").parquet(path)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)


def export_bundle(tables: dict[str, DataFrame], path: str, gian: tuple[DataFrame, DataFrame] | None = None, small: dict[str, object] | None = None) -> None:
    """A bundle below ``path``: every table as JSON lines, speeches with their normal form; ``gian`` (agenda, questioners)
    as fragments; what is ``small`` (dictionaries, topics, settings) as one JSON value each; and a list of all parts."""
    for name, df in tables.items():
        write_table(add_norm(df) if name == "speeches" else df, f"{path}/{name}", "json")
    parts = [(name, "lines") for name in tables]
    if gian:
        write_gian_fragments(*gian, f"{path}/gian")
        parts.append(("gian", "fragments"))
    some = next(iter(tables.values()), None) if tables else gian[0] if gian else None
    spark = some.sparkSession if some is not None else SparkSession.active()
    for name, value in (small or {}).items():
        spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
        parts.append((name, "value"))
    spark.createDataFrame(parts, "name string, form string").coalesce(1).write.mode("overwrite").json(f"{path}/parts")


def read_small(spark: SparkSession, path: str) -> object:
    """One of the small values of a bundle."""
    return json.loads(spark.read.text(path, wholetext=True).where("value <> ''").first()[0])
