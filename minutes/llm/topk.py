"""Exact top-k by inner product over a distributed M-tree.

Vectors are lifted by one coordinate, sqrt(M^2 - |x|^2) with M the greatest norm, so that all have the norm M and the
largest inner product is the least distance. The index is fitted on a bounded sample: PIVOTS routing vectors. Every
vector goes to its nearest one; vectors of one routing vector are cut into subtrees by a hash of the id, so that a crowd
of equal vectors is spread, and each subtree is stored as one row (``mtree``). A subtree has TREE vectors, more for a
table of over TREE * TREES, at most TREE_BYTES.

A query first searches one subtree of its nearest routing vector, which bounds the distance of its k-th neighbour; then
only the subtrees that can hold something nearer, by routing distance and covering radius. Queries go to subtrees: a
subtree that no query asks is not read, and one that very many ask (more than QUERY_BYTES of them) is searched in several
tasks. The best k of all subtrees are ranked by score. Scores are sums of products of whole numbers: as long as no squared
norm passes 2^48, all of them are exact in a double, and different ones have different distances. Longer vectors, which are
none or few, are left out of the index: they are held against all queries, and those of them that ask against all vectors,
in blocks, with whole numbers of any size. A score that a long cannot hold is null; its rank is right.

Defined cases: vectors that are null, or hold a null or a component that is not finite, take no part, nor do null ids;
shorter vectors count as filled up with zeros, empty and very long ones are vectors like any other; rows that repeat an
id count once (the least vector), and no query finds its own id; fewer than k other vectors give all of them; ties go to
the smaller id; an empty table gives no rows. Only the id and the vector column are read, under names of their own, so
other columns may have any name.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.scratch import narrow
from .common import stored
from .mtree import Points, Tree

#: Vectors in a subtree at least, subtrees from which on they grow instead, the most routing vectors.
TREE, TREES, PIVOTS = 8192, 512, 1024
#: Bytes of a subtree's vectors at most, of the queries that one task asks of it, and queries searched at once.
TREE_BYTES, QUERY_BYTES, QUERIES = 64 << 20, 32 << 20, 512
#: Up to this squared norm the roots of different squared distances are different doubles.
EXACT = 2.0**48
#: Queries and vectors of a block that are compared with whole numbers of any size; what such numbers are padded to.
LONG_QUERIES, LONG_VECTORS, DIGITS = 512, 4096, 1300


def vectors(df: DataFrame, id_col: str, vec_col: str, scale: Column | None = None) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    own = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull()).where(good.alias("good"))
    return own.groupBy("vec_id").agg(F.min("v").alias("v"))


def scaled(x: Column, by: float = 256.0) -> Column:
    """floor(by * x) as a double; beyond 2^53 a double is whole already, and a long might not hold it."""
    return F.when(F.abs(x * by) < 2.0**53, F.floor(x * by).cast("double")).otherwise(x * by)


def unpack(column: pa.Array, size: int) -> np.ndarray:
    out = np.zeros((len(column), size))
    flat, bounds = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
    if len(column) and (np.diff(bounds) == size).all():
        return flat.reshape(len(column), size).astype(float)
    for i in range(len(column)):
        out[i, : bounds[i + 1] - bounds[i]] = flat[bounds[i] : bounds[i + 1]]
    return out


def lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, top - (x * x).sum(1)))[:, None]])


def squared_norm() -> Column:
    return F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)


def search(all_vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query among ``all_vectors`` (vec_id, v) the k highest products."""
    base = stored(all_vectors, "vectors")
    far = squared_norm() > EXACT
    if not base.where(far).limit(1).count():
        return by_trees(base, is_query, k)
    near, asked = base.where(~far), base.where(is_query)
    found = [with_order(by_trees(near, is_query, k)), by_blocks(asked.where(~far), base.where(far), k), by_blocks(asked.where(far), base, k)]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("order"), "vec_id"))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def order_of(score: int) -> str:
    """A text that sorts like the number."""
    return f"{score + 10**DIGITS:0{DIGITS + 1}d}"


def with_order(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([order_of(x) for x in batch.column("score").to_pylist()], pa.string())], ["query_id", "vec_id", "score", "order"])

    return found.select("query_id", "vec_id", "score").mapInArrow(run, "query_id long, vec_id long, score long, order string")


def by_blocks(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, order): at least the k best of each query, by whole numbers of any size."""
    by, of = (max(1, -(-df.count() // n)) for df, n in ((queries, LONG_QUERIES), (candidates, LONG_VECTORS)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "v", deal(by).alias("i"), every(of).alias("j"))
    right = candidates.select("vec_id", "v", every(by).alias("i"), deal(of).alias("j"))

    def meet(asked: pa.Table, stored_: pa.Table) -> pa.Table:
        rows = []
        if len(asked) and len(stored_):
            ids = stored_.column("vec_id").to_pylist()
            size = max(len(v) for t in (asked, stored_) for v in t.column("v").to_pylist())
            q, x = (np.array([[int(c) for c in v] + [0] * (size - len(v)) for v in t.column("v").to_pylist()], object).reshape(len(t), size) for t in (asked, stored_))
            for name, scores in zip(asked.column("vec_id").to_pylist(), q @ x.T if size else np.zeros((len(q), len(x)), object), strict=True):
                best = heapq.nsmallest(k, ((-s, i) for s, i in zip(scores, ids, strict=True) if i != name))
                rows += [(name, i, -s if -(2**63) <= -s < 2**63 else None, order_of(-s)) for s, i in best]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], ["query_id", "vec_id", "score", "order"])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, "query_id long, vec_id long, score long, order string")


def by_trees(base: DataFrame, is_query: Column, k: int) -> DataFrame:
    """The same for stored vectors whose squared norms are at most EXACT."""
    spark = base.sparkSession
    norm = squared_norm()
    n, top, size = base.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], out)
    each = max(1, min(max(TREE, n // TREES), TREE_BYTES // (8 * (size + 1))))
    count = int(min(PIVOTS, max(1, -(-n // each))))
    chosen = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).select("v").toArrow()
    pivots = lift(unpack(chosen.column("v").combine_chunks(), size), top)
    sent = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = lift(unpack(part.column("v"), size), top)
                d2 = (x * x).sum(1)[:, None] - 2 * x @ sent.value.T + (sent.value * sent.value).sum(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(d2.argmin(1).astype(np.int32))], ["vec_id", "v", "pivot"])

    placed = stored(base.mapInArrow(place, "vec_id long, v array<double>, pivot int"), "placed")
    cuts = placed.groupBy("pivot").agg(F.ceil(F.count("*") / each).cast("int").alias("cuts"))
    spread = placed.join(F.broadcast(cuts), "pivot").withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = lift(unpack(pa.array(rows["v"]), size), top)
        tree = Tree(rows["vec_id"].to_numpy(), x, sent.value[key[0]], top)
        return pd.DataFrame({"pivot": [key[0]], "cut": [key[1]], "radius": [tree.radius], "tree": [pickle.dumps(tree, protocol=5)]})

    trees = stored(spread.groupBy("pivot", "cut").applyInPandas(build, "pivot int, cut int, radius double, tree binary"), "trees")
    queries = placed.where(is_query).withColumnRenamed("vec_id", "query_id")
    held = max(1, QUERY_BYTES // (8 * (size + 1)))

    def find(asked: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        names, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(one) and len(asked):
            tree: Tree = pickle.loads(one["tree"].iloc[0])
            for at in range(0, len(asked), QUERIES):
                part = asked.iloc[at : at + QUERIES]
                q = unpack(pa.array(part["v"]), size)
                own = part["query_id"].to_numpy()
                _, rows = tree.search(np.hstack([q, np.zeros((len(q), 1))]), own, k, part["reach"].to_numpy())
                i, j = np.nonzero(rows >= 0)
                names.append(own[i])
                found.append(tree.ids[rows[i, j]])
                scores.append(np.einsum("ij,ij->i", q[i], tree.points.x[rows[i, j], :-1]))
        return pd.DataFrame({"query_id": np.concatenate(names), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    def run(asked: DataFrame) -> DataFrame:
        """Searches of (pivot, cut, query_id, v, reach), each subtree sent once for every ``held`` queries that ask it."""
        parts = asked.groupBy("pivot", "cut").agg(F.ceil(F.count("*") / held).cast("int").alias("parts"))
        place = ["pivot", "cut", "part"]
        left = asked.join(narrow(parts), ["pivot", "cut"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        other = parts.select(F.col("pivot").alias("p"), F.col("cut").alias("c"), F.col("parts").alias("n"))
        right = trees.join(narrow(other), F.expr("pivot = p and cut = c")).select(F.col("p").alias("pivot"), F.col("c").alias("cut"), "tree", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
        return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(find, "query_id long, vec_id long, score double")

    first = queries.join(F.broadcast(cuts), "pivot").withColumn("cut", F.pmod(F.xxhash64("query_id"), F.col("cuts")).cast("int")).withColumn("reach", F.lit(float("inf")))
    near = run(first).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    # the distance of the k-th so far; d^2 = |q|^2 + M^2 - 2 q.x
    bound = F.sqrt(F.greatest(F.lit(0.0), norm + F.lit(float(top)) - 2 * F.col("least"))) * (1 + 1e-9) + 1e-6
    known = stored(queries.join(near, "query_id", "left").withColumn("reach", F.when(F.col("n") >= k, bound).otherwise(float("inf"))).select("query_id", "v", "reach"), "bounds")
    radii = np.zeros(count)
    for r in trees.groupBy("pivot").agg(F.max("radius").alias("radius")).collect():
        radii[r["pivot"]] = r["radius"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = np.hstack([unpack(batch.column("v"), size), np.zeros((batch.num_rows, 1))])
                reach = batch.column("reach").to_numpy()
                routes = Points(sent.value)
                kept = [np.flatnonzero(routes.distances(x, float(x @ x)) - radii <= r * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(x @ x))) for x, r in zip(q, reach, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.list_(pa.int32()))], ["query_id", "v", "reach", "pivots"])

    routed = known.mapInArrow(route, "query_id long, v array<double>, reach double, pivots array<int>")
    every = routed.withColumn("pivot", F.explode("pivots")).drop("pivots").join(narrow(trees.select("pivot", "cut")), "pivot")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = run(every).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def sql(vectors_of: str, every: int, k: int) -> str:
    """The same for floor(256 x) of a table with columns vec_id and embedding, every ``every``-th id asking."""
    return f"""
    WITH own AS (SELECT DISTINCT ON (vec_id) vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM {vectors_of}
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 ORDER BY vec_id, embedding),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM own q, own c WHERE q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}
    """
