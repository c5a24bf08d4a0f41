"""Tables that a job writes once to the folder in ``spark.checkpoint.dir`` and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
#: Rows of a narrow table that is broadcast: some 200 bytes each.
NARROW_ROWS = 200_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; where none is set, in one of our own if all of Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(f"file://{tempfile.mkdtemp(prefix='minutes-')}")
        base = _own_dir[0]
    return f"{base.rstrip('/')}/minutes/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_narrow(df: DataFrame, rows: int | None = None) -> bool:
    """Whether it is counted to have few rows."""
    rows = NARROW_ROWS if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def narrow(df: DataFrame, rows: int | None = None) -> DataFrame:
    """For the narrow side of a join with whole texts: broadcast if it is counted to have few rows, else as it is."""
    return F.broadcast(df) if is_narrow(df, rows) else df
