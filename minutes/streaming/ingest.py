"""Index text files as they arrive, each of them once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.normalize import add_norm
from ..operators import catalog, extraction, speeches
from ..sources.scratch import exists, narrow, stored
from ..sources.tables import key_of_file


def stream_index(spark: SparkSession, text_dir: str, meetings: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the speeches of new files below ``text_dir`` to ``out``, and stop when all there are have been read.

    Everything up to the speech row is narrow per file, so the stream has no state; the checkpoint remembers which files
    are done. A batch is written under its number, so one that is repeated after a failure replaces itself.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(text_dir)
    meeting, key = key_of_file(F.col("_metadata.file_name"))
    texts = files.select(meeting.alias("meeting_id"), key.alias("text_key"), F.col("value").alias("raw"))
    pdfs = catalog.flat_pdfs(meetings)

    def write(batch: DataFrame, number: int) -> None:
        rows = add_norm(speeches.build_index(batch, pdfs, meetings))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


T = TypeVar("T")
#: Buckets of meetings: what a batch touches is worked out again by bucket.
BUCKETS = 256
#: Folders that the speeches of a bucket may lie in before they are written as one.
FOLDERS = 16
TABLES = ("speeches", "agenda", "questioners")
_SCHEMAS = {"speeches": f"{schemas.SPEECHES}, norm string", "agenda": schemas.AGENDA, "questioners": schemas.QUESTIONERS}
_PARTS = "text_key string, meeting_id string, pdf_pos int, date string, pdf string, is_toc boolean, meeting string, type string, year int, era string, pos int, no string, title string, role string, name string, text string, batch int, bucket int, kind string"


def ingest(texts: DataFrame, number: int, meetings: DataFrame, out: str, buckets: int = BUCKETS) -> None:
    """Bring the tables below ``out`` up to date with a batch of texts (text_key, raw).

    What the batch's texts hold is kept under the batch's number. Then the bills and questioners of the meetings in the buckets
    it touches are merged anew from everything kept of them, the latest version of each file, and written under that
    number too. Speeches are not merged: those of the batch are written beside the ones there are. Only where a batch has
    a new version of a file, or the speeches of a bucket lie in ``FOLDERS`` folders, all of the bucket are written anew. A
    last, small table tells which buckets were touched, and which batches' folders have their speeches. Readers take each
    bucket as the latest finished batch tells, so they never see half of one, and a batch that is repeated after a
    failure replaces what it had written. The work is that of the batch and of the bills in its buckets.
    """
    spark = texts.sparkSession
    dealt = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("meeting_id"), F.lit(buckets)).cast("int"))
    kept = f"{out}/parts/batch={number}"
    # by folder first: else every task would leave a file in each of them
    dealt(extraction.extract(texts, meetings)).hint("rebalance", "bucket", "kind").write.mode("overwrite").partitionBy("bucket", "kind").parquet(kept)
    parts = spark.read.schema(_PARTS).parquet(f"{out}/parts")
    touched = sorted(r["bucket"] for r in parts.where((F.col("batch") == number) & (F.col("kind") == extraction.FILE)).select("bucket").distinct().collect())
    known = parts.where((F.col("batch") <= number) & F.col("bucket").isin(touched))
    before = {b: x for b, x in _finished(spark, out, number).items() if b in touched}
    stale = stored(_stale(known), "stale")
    anew = {b for b, (_, folders) in before.items() if len(folders) >= FOLDERS}
    anew |= {r["bucket"] for r in stale.where(_in({b: v for b, (v, _) in before.items()}, lambda v: (F.col("batch") <= v) & (F.col("latest") > v))).select("bucket").distinct().collect()}
    if not stale.isEmpty():
        known = known.join(narrow(stale.drop("bucket", "latest")), ["meeting_id", "text_key", "batch"], "left_anti")
    since = {b: before[b][0] if b in before and b not in anew else None for b in touched}
    added = known.where(_in(since, lambda v: F.lit(True) if v is None else F.col("batch") > v))
    for name, df in (extraction.tables_of(known) | {"speeches": extraction.speeches_of(added)}).items():
        own = add_norm(df) if name == "speeches" else df
        folders = ["bucket", "year"] if name == "speeches" else ["bucket"]
        dealt(own).hint("rebalance", *folders).write.mode("overwrite").partitionBy(*folders).parquet(f"{out}/{name}/batch={number}")
    done = [(b, [*(before[b][1] if v is not None else []), number]) for b, v in since.items()]
    spark.createDataFrame(done, "bucket int, folders array<int>").coalesce(1).write.mode("overwrite").parquet(f"{out}/done/batch={number}")


def _stale(rows: DataFrame) -> DataFrame:
    """(meeting_id, text_key, bucket, batch, latest) of the versions of files that have a later one; they are few or none."""
    files = rows.where(F.col("kind") == extraction.FILE).groupBy("meeting_id", "text_key", "bucket").agg(F.collect_set("batch").alias("all"))
    old = files.where(F.size("all") > 1).withColumn("latest", F.array_max("all"))
    return old.select("meeting_id", "text_key", "bucket", F.explode("all").alias("batch"), "latest").where("batch < latest")


def _in(found: dict[int, T], rule: Callable[[T], Column]) -> Column:
    """The rows of each bucket that keep to the ``rule`` of what was found for it; buckets of one rule are named together."""
    own: dict[T, list[int]] = {}
    for b, x in found.items():
        own.setdefault(x, []).append(b)
    return reduce(or_, (F.col("bucket").isin(bs) & rule(x) for x, bs in own.items()), F.lit(False))


def _finished(spark: SparkSession, out: str, number: int | None = None) -> dict[int, tuple[int, tuple[int, ...]]]:
    """For each bucket the last finished batch that touched it (before batch ``number``), and the batches in whose folders
    its speeches lie."""
    if not exists(spark, f"{out}/done"):
        return {}
    done = spark.read.schema("bucket int, folders array<int>, batch int").parquet(f"{out}/done")
    done = done if number is None else done.where(F.col("batch") < number)
    last = done.groupBy("bucket").agg(F.max("batch").alias("batch"), F.max_by("folders", "batch").alias("folders"))
    # a row for each bucket; tables of earlier releases name no folders and have all speeches in the last one
    return {r["bucket"]: (r["batch"], tuple(r["folders"] or [r["batch"]])) for r in last.collect()}


def versions(spark: SparkSession, out: str) -> dict[int, list[int]]:
    """The buckets that each finished batch was the last to write."""
    found: dict[int, list[int]] = {}
    for bucket, (batch, _) in _finished(spark, out).items():
        found.setdefault(batch, []).append(bucket)
    return found


def read_tables(spark: SparkSession, out: str, buckets: list[int] | None = None) -> dict[str, DataFrame]:
    """speeches (with their normal form, by year), agenda and questioners as of the last finished batch; of ``buckets`` alone
    if they are given, and then with a column bucket."""
    now = {b: x for b, x in _finished(spark, out).items() if buckets is None or b in buckets}
    merged, said = _in({b: batch for b, (batch, _) in now.items()}, lambda v: F.col("batch") == v), _in({b: folders for b, (_, folders) in now.items()}, lambda vs: F.col("batch").isin(*vs))
    gone = ["batch"] if buckets is not None else ["batch", "bucket"]
    there = lambda name: spark.read.schema(f"{_SCHEMAS[name]}, batch int, bucket int").parquet(f"{out}/{name}").where(said if name == "speeches" else merged).drop(*gone)
    return {name: there(name) for name in TABLES}


def vacuum(spark: SparkSession, out: str) -> int:
    """Delete the folders of tables that a later finished batch has replaced; how many there were. For times without readers."""
    latest = _finished(spark, out)
    done = spark.read.schema("bucket int, batch int").parquet(f"{out}/done").distinct().collect()
    old = [(r["batch"], r["bucket"]) for r in done if r["batch"] < latest[r["bucket"]][0]]
    gone = 0
    for name in TABLES:
        for batch, bucket in old:
            if name == "speeches" and batch in latest[bucket][1]:
                continue
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}/batch={batch}/bucket={bucket}")
            gone += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return gone


def stream_tables(spark: SparkSession, text_dir: str, meetings: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS, files_per_batch: int = 10_000) -> StreamingQuery:
    """``ingest`` of new or changed files below ``text_dir`` in batches, until all there are have been read."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_per_batch).load(text_dir)
    texts = files.select(key_of_file(F.col("_metadata.file_name"))[1].alias("text_key"), F.col("value").alias("raw"))
    return texts.writeStream.foreachBatch(lambda batch, number: ingest(batch, number, meetings, out, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
