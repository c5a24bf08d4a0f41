"""Embeddings as signed bytes and exact nearest neighbours by inner product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

INPUT, PREFIX, STEPS = 512, "passage: ", 127
#: Queries of a block, values of a block of vectors, and vectors that are worked on at once.
QUERIES, VALUES, CHUNK = 4096, 1 << 22, 1024


def embedding_input(speeches: DataFrame) -> DataFrame:
    return speeches.select("sid", F.concat(F.lit(PREFIX), F.substring(F.coalesce("text", F.lit("")), 1, INPUT)).alias("input"))


def quantize_int8(vec: Column) -> Column:
    """Components times 127, halves rounded up, within -127 and 127."""
    return F.transform(vec, lambda x: F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), F.floor(x * STEPS + 0.5))).cast("byte"))


def dequantize(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double") / STEPS)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_search(vectors: DataFrame, query: list[float], k: int = 20, id_col: str = "sid", vec_col: str = "vec") -> DataFrame:
    """The k rows nearest to one query, ties by id: a scan and a top-k, all in the engine."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(id_col, dot(dequantize(F.col(vec_col)), q).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def vector_search_many(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "sid", vec_col: str = "vec") -> DataFrame:
    """(query, id, score, rank) for every row (query long, vec, not normalised) of ``queries``, ids being distinct.

    Queries and vectors are dealt into blocks of bounded size by their ids, and every pair of blocks meets in a task of its
    own; it keeps k for each of its queries, and only those are shuffled again. So the plan is the same for any number of
    queries, and none of them come to the driver.
    """
    shape, asked = vectors.agg(F.max(F.size(vec_col)), F.count("*")).first(), queries.count()
    per_block = max(CHUNK, VALUES // max(1, shape[0] or 1))
    by, of = max(1, -(-asked // QUERIES)), max(1, -(-shape[1] // per_block))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    deal = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    left = queries.where(F.col(vec_col).isNotNull()).select(F.col("query").cast("long").alias("query"), F.col(vec_col).cast("array<double>").alias("v"), deal("query", by).alias("__q"), every(of).alias("__v"))
    right = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), every(by).alias("__q"), deal(id_col, of).alias("__v"))
    cells = left.groupBy("__q", "__v").cogroup(right.groupBy("__q", "__v"))
    kind = dict(right.dtypes)["id"]

    def meet(asked: pa.Table, stored: pa.Table) -> pa.Table:
        names, ids, scores = nearest(asked, stored, k)
        return pa.table([names, ids, scores], ["query", "id", "score"])

    near = cells.applyInArrow(meet, f"query long, id {kind}, score double").withColumnRenamed("id", id_col)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), id_col))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(asked: pa.Table, stored: pa.Table, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Up to k nearest stored vectors of every query, ties by id: (queries, ids, scores).

    Vectors come in order of their length, longest first. A query is done when even a vector in its own direction would
    stay below its k-th score so far (Cauchy and Schwarz), and a block of vectors is held against the others alone.
    """
    kind = stored.schema.field("id").type
    if not len(asked) or not len(stored):
        return pa.array([], pa.int64()), pa.array([], kind), pa.array([], pa.float64())
    q, v = matrix(asked.column("v")), matrix(stored.column("v"))
    length = np.sqrt((v**2).sum(1))
    order = np.argsort(-length, kind="stable")
    # the place of each id among all, so that ties are settled by whole numbers
    place = np.empty(len(v), np.int64)
    place[pc.sort_indices(stored.column("id")).to_numpy()] = np.arange(len(v))
    reach = np.sqrt((q**2).sum(1))
    floor = np.full(len(q), -np.inf)
    best = np.zeros((0, 3))  # query, score, place
    for a in range(0, len(v), CHUNK):
        rows = order[a : a + CHUNK]
        live = np.flatnonzero(reach * length[rows[0]] * (1 + 1e-9) / STEPS >= floor)
        if not len(live):
            break
        scores = q[live] @ v[rows].T / STEPS  # products of whole numbers are exact
        m = min(k, len(rows))
        # all that reach the m-th score here and the k-th so far, so that ties at the edge are left to the order by id
        edge = np.maximum(-np.partition(-scores, m - 1, axis=1)[:, m - 1], floor[live])
        i, j = np.nonzero(scores >= edge[:, None])
        best = np.concatenate([best, np.stack([live[i], scores[i, j], place[rows[j]]], 1)])
        best = best[np.lexsort((best[:, 2], -best[:, 1], best[:, 0]))]
        first = np.searchsorted(best[:, 0], np.arange(len(q)))
        nth = np.arange(len(best)) - first[best[:, 0].astype(np.int64)]
        best, nth = best[nth < k], nth[nth < k]
        full = nth == k - 1
        floor[best[full, 0].astype(np.int64)] = best[full, 1]
    at = np.empty(len(v), np.int64)
    at[place] = np.arange(len(v))
    names = asked.column("query").combine_chunks().take(pa.array(best[:, 0].astype(np.int64)))
    return names, stored.column("id").combine_chunks().take(pa.array(at[best[:, 2].astype(np.int64)])), pa.array(best[:, 1])


def hybrid_candidates(matched: DataFrame, near: DataFrame, speeches: DataFrame, k: int = 20) -> DataFrame:
    """The best of a keyword search (sid, score) and of a vector search (sid, score), with what a citation needs."""
    word = matched.select("sid", "score").orderBy(F.desc("score"), "sid").limit(k).select("sid", F.lit(True).alias("by_word"), F.lit(False).alias("by_vector"))
    vec = near.select("sid", F.lit(False).alias("by_word"), F.lit(True).alias("by_vector"))
    both = word.unionByName(vec).groupBy("sid").agg(F.max("by_word").alias("by_word"), F.max("by_vector").alias("by_vector"))
    return both.join(speeches.select("sid", "name", "role", "date", "pdf", "text"), "sid")
