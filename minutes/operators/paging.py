"""Deep pages of a ranked result, each read from the range of ranks it lies in.

``rank`` with ``page`` sorts everything before a page. Here the ranking is written once, without texts: Spark samples the
order, deals rows to ranges of it and sorts each; rows keep their range and their place in it, and the exact sizes of the
ranges tell the rank of each range's first row. A page then reads the one or two ranges (folders) that its ranks fall in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .search import PAGE, rank_columns

#: Rows of a range, about.
RANGE_ROWS = 1_000_000


def write_ranking(matched: DataFrame, path: str, by: str = "date", order: list[str] | None = None, rows: int = RANGE_ROWS) -> None:
    """Write the rows of ``matched`` (what a page shows or joins by; date, score and the columns of ``order``) as ranked by
    ``search.rank``. Rows that nothing in the order tells apart keep one order, whichever it is, for all pages."""
    keys = rank_columns(by, order or ["ord"])
    ranges = max(1, -(-matched.count() // rows))
    placed = matched.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    # the number of a row is that of its range and its place there
    own = placed.withColumn("chunk", F.shiftright("__at", 33).cast("int")).withColumn("place", F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")
    own.write.mode("overwrite").partitionBy("chunk").parquet(f"{path}/rows")
    own.limit(0).drop("chunk").write.mode("overwrite").parquet(f"{path}/columns")
    sizes = read_rows(matched.sparkSession, path).groupBy("chunk").agg(F.count("*").alias("n"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/columns").schema.add("chunk", IntegerType())
    return spark.read.schema(schema).parquet(f"{path}/rows")


def ranges_of(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(chunk, rank before its first row, rows) of the ranges in order: one for each RANGE_ROWS rows."""
    out, before = [], 0
    for r in sorted(spark.read.parquet(f"{path}/ranges").collect(), key=lambda r: r["chunk"]):
        out.append((r["chunk"], before, r["n"]))
        before += r["n"]
    return out


def read_page(spark: SparkSession, path: str, n: int = 1, size: int = PAGE) -> DataFrame:
    """The n-th page of a written ranking, with its ranks from 1."""
    low, high = (n - 1) * size, n * size
    here = [(c, before) for c, before, rows in ranges_of(spark, path) if before < high and before + rows > low]
    first = F.lit(0)
    for chunk, before in here:
        first = F.when(F.col("chunk") == chunk, before).otherwise(first)
    rows = read_rows(spark, path).where(F.col("chunk").isin([c for c, _ in here])).withColumn("rank", first + F.col("place") + 1)
    return rows.where((F.col("rank") > low) & (F.col("rank") <= high)).drop("chunk", "place").orderBy("rank")
