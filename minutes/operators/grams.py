"""Search without a full scan: an index of character grams tells which blocks of speeches can hold a term.

Speeches are written by year and block, each block a folder of about ``block_bytes`` of normal forms, which a speech goes to
by a hash of its key. The index has a row for each gram (a run of 1, 2 or 3 characters of a normal form) with the blocks
that hold it; one found in over half of all blocks rules out little and has no list. A text that holds a term holds all
of the term's grams, so blocks without one of them are left out as folders, before anything in them is read, and the
search itself runs on what is left. Short terms are looked up by grams of their own length, so nothing is missed.

Grams are keyed by their code points, 21 bits each. The index is sorted by key, so a lookup reads a few row groups of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import add_norm
from ..sources.scratch import narrow
from . import search as plain
from .search import Term

SIZES = (1, 2, 3)
BLOCK_BYTES = 64 << 20
#: Blocks that are named to the scan one by one; if more can hold a match, all are read.
MOST_BLOCKS = 5000
#: Code points whose grams a task works out at once, and keys it holds before it hands them on.
SLICE, HOLD = 1 << 20, 4_000_000
_BETWEEN = 0x110000


def keys(codes: np.ndarray, size: int) -> np.ndarray:
    """The distinct grams of a stretch of code points, none of them across _BETWEEN."""
    n = len(codes) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out, whole = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(size):
        out = (out << 21) | codes[i : i + n]
        whole &= codes[i : i + n] != _BETWEEN
    return np.unique(out[whole])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def term_keys(term: str, sizes: tuple[int, ...] = SIZES) -> set[int]:
    """The grams, of the greatest size that fits, which a text that holds the term must have."""
    size = max((s for s in sizes if s <= len(term)), default=0)
    return set(keys(code_points(term), size).tolist()) if size else set()


def write_blocks(speeches: DataFrame, path: str, id_cols: list[str], block_bytes: int = BLOCK_BYTES) -> None:
    """The table of speeches with normal forms, in folders by year and block."""
    own = add_norm(speeches)
    sizes = own.groupBy(F.col("year").alias("__year")).agg(F.ceil(F.sum(F.octet_length("norm")) / block_bytes).cast("int").alias("__n"))
    block = F.pmod(F.xxhash64(*id_cols), F.greatest(F.col("__n"), F.lit(1))).cast("int")
    dealt = own.join(narrow(sizes), F.col("year").eqNullSafe(F.col("__year"))).withColumn("block", block).drop("__year", "__n")
    dealt.hint("rebalance", "year", "block").write.mode("overwrite").partitionBy("year", "block").parquet(f"{path}/speeches")
    # folders alone tell no columns if there is no row
    dealt.limit(0).write.mode("overwrite").parquet(f"{path}/columns")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/speeches")


def read_grams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram long, blocks array<struct<year: int, block: int>>").parquet(f"{path}/grams")


def block_grams(rows: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(gram, year, block) of rows with year, block and norm; distinct for each task's stretch of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[tuple, list[str]] = {}
        found: dict[tuple, list[np.ndarray]] = {}
        waiting = held = 0

        def gather() -> int:
            n = 0
            for at, own in texts.items():
                codes = np.concatenate([c for t in own for c in (code_points(t), [_BETWEEN])])
                made = [keys(codes, s) for s in sizes]
                found.setdefault(at, []).extend(made)
                n += sum(map(len, made))
            texts.clear()
            return n

        def rows_of() -> Iterator[pa.RecordBatch]:
            for (year, block), parts in found.items():
                own = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([year] * len(own), pa.int32()), pa.array([block] * len(own), pa.int32())], ["gram", "year", "block"])
            found.clear()

        for batch in batches:
            for year, block, norm in zip(*(batch.column(c).to_pylist() for c in ("year", "block", "norm")), strict=True):
                texts.setdefault((year, block), []).append(norm or "")
                waiting += len(norm or "") + 1
                if waiting > SLICE:
                    held += gather()
                    waiting = 0
                if held > HOLD:
                    yield from rows_of()
                    held = 0
        gather()
        yield from rows_of()

    return rows.select(F.col("year").cast("int").alias("year"), F.col("block").cast("int").alias("block"), "norm").mapInArrow(run, "gram long, year int, block int")


def write_grams(speeches: DataFrame, path: str, sizes: tuple[int, ...] = SIZES) -> None:
    """The index of a table of blocks: (gram, blocks), without a list for grams in over half of them."""
    total = speeches.select("year", "block").distinct().count()
    lists = block_grams(speeches, sizes).groupBy("gram").agg(F.collect_set(F.struct("year", "block")).alias("blocks"))
    kept = lists.select("gram", F.when(F.size("blocks") * 2 <= total, F.col("blocks")).alias("blocks"))
    kept.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(path)


def build(speeches: DataFrame, path: str, id_cols: list[str], block_bytes: int = BLOCK_BYTES, sizes: tuple[int, ...] = SIZES) -> None:
    """Write the blocks of a table of speeches and their index below ``path``."""
    write_blocks(speeches, path, id_cols, block_bytes)
    write_grams(read_blocks(speeches.sparkSession, path), f"{path}/grams", sizes)


def needed(groups: list[list[Term]], sizes: tuple[int, ...] = SIZES) -> list[list[list[set[int]]]]:
    """For each group, for each of its positive terms, the grams of each alternative. What is only negated rules out nothing."""
    return [[[term_keys(a, sizes) for a in t.alternatives] for t in g if not t.negative] for g in groups]


def candidate_blocks(index: DataFrame, groups: list[list[Term]], sizes: tuple[int, ...] = SIZES, most: int = MOST_BLOCKS) -> list[tuple[int | None, int]] | None:
    """The (year, block) that can hold a match; None if there are too many of them to name, or the query rules out none."""
    wanted = needed(groups, sizes)
    every = sorted({k for g in wanted for t in g for a in t for k in a})
    if not every:
        return None
    rows = index.where(F.col("gram").isin(every))
    common = {r["gram"] for r in rows.where("blocks IS NULL").select("gram").collect()}  # at most the query's grams
    holds = lambda a: reduce(and_, (F.array_contains("held", F.lit(k)) for k in sorted(a - common)), F.lit(True))
    term = lambda t: reduce(or_, map(holds, t), F.lit(False))
    free = lambda t: any(a <= common for a in t)
    if any(all(map(free, g)) for g in wanted):
        return None
    test: Column = reduce(or_, (reduce(and_, (term(t) for t in g if not free(t))) for g in wanted))
    placed = rows.where("blocks IS NOT NULL").select("gram", F.explode("blocks").alias("b")).groupBy("b.year", "b.block").agg(F.collect_set("gram").alias("held"))
    found = placed.where(test).select("year", "block").limit(most + 1).collect()
    return sorted(((r["year"], r["block"]) for r in found), key=str) if len(found) <= most else None


def in_blocks(blocks: list[tuple[int | None, int]]) -> Column:
    """A condition on folders alone, so that others are not even listed among the files to read."""
    by_year: dict[int | None, list[int]] = {}
    for year, block in blocks:
        by_year.setdefault(year, []).append(block)
    here = lambda year: F.col("year").isNull() if year is None else F.col("year") == year
    return reduce(or_, (here(y) & F.col("block").isin(b) for y, b in by_year.items()), F.lit(False))


def search(spark: SparkSession, path: str, query: str, dictionaries: dict | None = None, sizes: tuple[int, ...] = SIZES, **filters) -> DataFrame:
    """As ``search.search`` over the speeches of ``build``, from the blocks alone that can hold a match."""
    speeches = read_blocks(spark, path)
    blocks = candidate_blocks(read_grams(spark, path), plain.compile_query(query, **(dictionaries or {})), sizes)
    own = speeches if blocks is None else speeches.where(in_blocks(blocks))
    return plain.search(own, query, dictionaries=dictionaries, **filters)
