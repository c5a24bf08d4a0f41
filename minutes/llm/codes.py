"""Vector codes: product quantisation whose codebooks are fitted by the filtering form of Lloyd's algorithm.

A vector of whole numbers (each component times ``scale``, rounded down) is cut into equal consecutive parts. Every part
position has a codebook; it starts as that part of the first vectors by id, and in each round every part goes to its
nearest entry (squared Euclidean distance, ties to the lower index) and an entry becomes the componentwise mean, rounded
down, of its parts. At the end a vector is the list of its parts' nearest entries.

Every partition deals its vectors into blocks and builds a kd-tree over each part position of a block. A tree is a
balanced order of the points, so that the nodes of a level are runs of equal length, each with its bounding box, its sum
and its count, worked out from the leaves upwards. A round sends the codebooks (their size is a parameter's) down the
trees, a level at a time: of a node's candidates, one is dropped where another is nearer to the corner of the box that
favours the first most, since it is then nearer to all points in the box. A node with one candidate left gives that entry
its sum and count as a whole and is not entered; in a leaf, each point is held against what is left. The trees depend on
the vectors alone, so they are stored once and read by all rounds. What leaves a task is one sum for each entry.

All arithmetic is on whole numbers. Components whose squares fit 64 bits are numpy integers; blocks with a larger one, and
codebooks with a larger entry, are worked out in Python's integers by the same code. Sums travel in limbs of 40 bits.

Defined cases: a vector that is null, or holds null, a non-finite component or one beyond 2^500, takes no part; nor does
one whose length is not the most frequent (of several, the greatest). Where the parts do not divide the length, zeros
follow. Fewer vectors than entries make smaller codebooks; equal starting entries leave all but the first unused. A null
id goes behind all others and keeps its row; repeated ids are rows like others, by vector where they start a codebook.
Errors beyond a long, and sums that hold one, are null. Null labels are equal to each other. An empty table gives no rows.
Only id, vector and label are read, under names of their own, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import narrow
from .common import stored

#: Vectors of a block, and values of it at most (a longer vector stands alone).
BLOCK, BLOCK_VALUES = 4096, 1 << 19
#: Points of a leaf, about.
LEAF = 8
#: Values that one step of the filter holds.
STEP = 1 << 21
LONGEST, LIMB = (1 << 63) - 1, 40
#: Components beyond it are no numbers of any use, and their product with a scale may not be finite.
HUGE = 2.0**500


def kept(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None) -> DataFrame:
    """(id, v, label) of the vectors that take part, all of one length."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    sound = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) <= HUGE))  # NaN is greater than any number
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), label.alias("label")).where(F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("v") == (size["size"] if size else 0))


def whole(v: np.ndarray, scale: float, width: int) -> np.ndarray:
    """Rows of components as whole numbers in doubles, filled up with zeros to ``width``."""
    out = np.zeros((len(v), width))
    out[:, : v.shape[1]] = np.floor(v * scale)
    return out


def bound(dims: int) -> int:
    """Components up to it have squared distances over ``dims`` of them, and sums of many, within 64 bits."""
    return int((2**58 // max(1, dims)) ** 0.5)


def exact(values: np.ndarray, most: int) -> np.ndarray:
    """Whole numbers in doubles as integers: numpy's up to ``most``, else Python's."""
    if not values.size or np.abs(values).max() <= most:
        return values.astype(np.int64)
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def starts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin in the order of n points."""
    return (np.arange(1 << level) * n) >> level


def depth(n: int) -> int:
    """The level of the leaves."""
    return max(0, (n // LEAF).bit_length() - 1)


def tree_order(points: np.ndarray) -> np.ndarray:
    """The order of the points in a kd-tree: every node is cut in the middle along the widest side of its box."""
    n, order = len(points), np.arange(len(points))
    for level in range(depth(n)):
        first, own = starts(n, level), points[order]
        axis = (np.maximum.reduceat(own, first) - np.minimum.reduceat(own, first)).argmax(1)
        node = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        order = order[np.lexsort((own[np.arange(n), axis[node]], node))]
    return order


@dataclass
class Tree:
    """Points in the order of the tree; for each level, from the root, the boxes and sums of its nodes."""

    points: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    total: list[np.ndarray]

    @staticmethod
    def of(points: np.ndarray) -> Tree:
        first = starts(len(points), depth(len(points)))
        low, high, total = ([f.reduceat(points, first)] for f in (np.minimum, np.maximum, np.add))
        for found, join in ((low, np.minimum), (high, np.maximum), (total, np.add)):
            while len(found[0]) > 1:
                found.insert(0, join(found[0][0::2], found[0][1::2]))
        return Tree(points, low, high, total)


def filtered(low: np.ndarray, high: np.ndarray, entries: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Which candidates of each box may still be nearest to a point in it (lower index first among equals)."""
    out = np.empty_like(live)
    step = max(1, STEP // max(1, entries.size))
    for a in range(0, len(low), step):
        lo, hi, own = low[a : a + step, None], high[a : a + step, None], live[a : a + step]
        # any candidate may be held against the others; one near the middle of the box drops most
        gap = ((2 * entries - lo - hi) ** 2).sum(2)
        best = np.where(own, gap, gap.max() + 1).argmin(1)
        other = entries[best][:, None]
        corner = np.where(entries > other, hi, lo)
        # squared distances to the corner: the candidate's less the best one's
        more = ((entries - other) * (entries + other - 2 * corner)).sum(2)
        index = np.arange(len(entries))
        out[a : a + step] = own & ~((more > 0) | ((more == 0) & (index > best[:, None])))
    return out


def assign(tree: Tree, entries: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points of each entry; with ``codes`` also each point's entry, in the order of the tree."""
    n = len(tree.points)
    total = np.zeros(entries.shape, tree.points.dtype)
    count = np.zeros(len(entries), np.int64)
    last, nodes, live = len(tree.low) - 1, np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    for level in range(last + 1):
        first = np.append(starts(n, level), n)
        live = filtered(tree.low[level][nodes], tree.high[level][nodes], entries, live)
        alone = live.sum(1) == 1
        done, to = nodes[alone], live[alone].argmax(1)
        np.add.at(total, to, tree.total[level][done])
        np.add.at(count, to, first[done + 1] - first[done])
        if codes is not None:
            for node, entry in zip(done, to, strict=True):
                codes[first[node] : first[node + 1]] = entry
        nodes, live = nodes[~alone], live[~alone]
        if level < last:
            nodes, live = (2 * nodes[:, None] + [0, 1]).ravel(), np.repeat(live, 2, 0)
    size = first[nodes + 1] - first[nodes]
    at = np.repeat(first[nodes] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    live = np.repeat(live, size, 0)
    step = max(1, STEP // max(1, entries.size))
    for a in range(0, len(at), step):
        own = tree.points[at[a : a + step]]
        gap = ((own[:, None] - entries) ** 2).sum(2)
        to = np.where(live[a : a + step], gap, gap.max() + 1).argmin(1)
        np.add.at(total, to, own)
        np.add.at(count, to, 1)
        if codes is not None:
            codes[at[a : a + step]] = to
    return total, count


def plant(rows: DataFrame, parts: int, scale: float, width: int) -> DataFrame:
    """Blocks of vectors (ids, labels, n) with the order and the points of their trees, part by part."""
    kinds = dict(rows.dtypes)
    size = max(1, min(BLOCK, BLOCK_VALUES // max(1, width)))

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = len(batch)
        v = batch.column("v")
        points = whole(v.flatten().to_numpy().reshape(n, -1), scale, width).reshape(n, parts, -1)
        orders = [tree_order(points[:, p]) for p in range(parts)]
        laid = np.stack([points[o, p] for p, o in enumerate(orders)])
        small = np.abs(laid).max() < 2**31 if laid.size else True
        binary = [np.stack(orders).astype(np.int32).tobytes(), laid.astype(np.int32 if small else np.float64).tobytes()]
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(c)) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([n], pa.int32()), *(pa.array([b], pa.binary()) for b in binary)], ["ids", "labels", "n", "order", "points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for a in range(0, len(batch), size):
                piece = batch.slice(a, size)
                if n + len(piece) > size:
                    yield block(pa.concat_batches(held))
                    held, n = [], 0
                held.append(piece)
                n += len(piece)
        if n:
            yield block(pa.concat_batches(held))

    return rows.mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, n int, order binary, points binary")


def laid_points(row: dict, parts: int, width: int) -> np.ndarray:
    """The points of a block: part, place in the part's tree, component."""
    n, data = row["n"], row["points"]
    kind = np.int32 if len(data) == 4 * n * width else np.float64
    return exact(np.frombuffer(data, kind).reshape(parts, n, -1), bound(width))


def integers(entries: list[list[list[int]]], most: int) -> list[np.ndarray]:
    """The codebook of each part position; Python's integers where an entry is large."""
    return [np.array(book, np.int64 if max((abs(x) for e in book for x in e), default=0) <= most else object) for book in entries]


def sums(blocks: DataFrame, entries: list[list[list[int]]], parts: int, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(count, sum of each component) of the parts nearest to each entry, by part position and entry."""
    books = integers(entries, bound(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[0, 0] for _ in range(parts)]
        for batch in batches:
            for row in batch.to_pylist():
                for p, points in enumerate(laid_points(row, parts, width)):
                    total, count = assign(Tree.of(points), books[p])
                    held[p] = [held[p][0] + total.astype(object), held[p][1] + count]
        out = [(p, e, i, n, int(x)) for p, (total, count) in enumerate(held) if not np.isscalar(count) for e in np.flatnonzero(count) for i, x in enumerate([count[e], *total[e]]) for n, x in enumerate(limbs(int(x)))]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(),) * 4 + (pa.int64(),), strict=True)], ["part", "entry", "place", "limb", "x"])

    found = blocks.mapInArrow(run, "part int, entry int, place int, limb int, x long").groupBy("part", "entry", "place", "limb").agg(F.sum("x").alias("x"))
    values: dict[tuple[int, int], dict[int, int]] = {}
    for r in found.collect():  # at most some limbs for each component of the codebooks
        own = values.setdefault((r["part"], r["entry"]), {})
        own[r["place"]] = own.get(r["place"], 0) + (r["x"] << (LIMB * r["limb"]))
    return {at: (own[0], [own[i] for i in range(1, len(own))]) for at, own in values.items()}


def limbs(x: int) -> list[int]:
    """A whole number in pieces of LIMB bits, the last of which has the sign."""
    out = []
    while not -(1 << LIMB) <= x < 1 << LIMB:
        out.append(x & ((1 << LIMB) - 1))
        x >>= LIMB
    return [*out, x]


def coded(blocks: DataFrame, entries: list[list[list[int]]], parts: int, width: int) -> DataFrame:
    """(id, label, code, error) of every vector."""
    kinds = dict(blocks.dtypes)
    books = integers(entries, bound(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["ids", "labels"]).to_pylist()):
                n = row["n"]
                order = np.frombuffer(row["order"], np.int32).reshape(parts, n)
                codes, error = np.empty((n, parts), np.uint8), 0
                for p, points in enumerate(laid_points(row, parts, width)):
                    own = np.empty(n, np.uint8)
                    assign(Tree.of(points), books[p], own)
                    gap = np.empty(n, object)
                    gap[order[p]] = ((points - books[p][own]) ** 2).sum(1)
                    codes[order[p], p] = own
                    error = error + gap
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array([text[2 * parts * k : 2 * parts * (k + 1)] for k in range(n)]), pa.array([int(x) if x <= LONGEST else None for x in error], pa.int64())],
                    ["id", "label", "code", "error"],
                )

    return blocks.mapInArrow(run, f"id {kinds['ids'][6:-1]}, label {kinds['labels'][6:-1]}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector that takes part.

    ``code`` has two hex digits for each part; ``error`` is the sum of squared distances to the entries, ``label_error``
    its sum over equal labels; the digest is of the final codebooks, written as decimal numbers.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = kept(vectors, id_col, vec_col, label_col)
    first = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    each = max(1, -(-len(first[0]) // parts)) if first else 1
    width = each * parts
    start = [[int(x) for x in row] for row in whole(np.array(first, float).reshape(len(first), -1), scale, width)] if first else []
    books = [[v[p * each : (p + 1) * each] for v in start] for p in range(parts)]
    blocks = stored(plant(rows, parts, scale, width), "trees")
    for _ in range(rounds if first else 0):
        found = sums(blocks, books, parts, width)
        books = [[[x // found[p, e][0] for x in found[p, e][1]] if (p, e) in found else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    each_row = stored(coded(blocks, books, parts, width), "codes")
    totals = each_row.groupBy(F.col("label").alias("of")).agg(F.when(F.count("*") == F.count("error"), F.try_sum("error")).alias("label_error"))
    out = each_row.join(narrow(totals), F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(table: str, parts: int, entries: int, rounds: int) -> str:
    """``compress`` in DuckDB, for vectors of one length that ``parts`` divides."""
    number = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)"
    near = "SELECT vec_id, label, part, x, min((gap, e)) AS best FROM (SELECT p.*, b.e, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.y[i]) * (p.x[i] - b.y[i])))::BIGINT AS gap FROM parts p JOIN {book} b USING (part)) GROUP BY ALL"
    steps = [f"""vectors AS (SELECT vec_id, label, {number} AS v FROM {table} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p::INT AS part, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM vectors, range({parts}) r(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM vectors ORDER BY vec_id LIMIT {entries}),
book0 AS (SELECT part, e, x AS y FROM parts JOIN first USING (vec_id))"""]
    for i in range(rounds):
        steps.append(f"""near{i} AS ({near.format(book=f"book{i}")}),
means{i} AS (SELECT part, e, list(m ORDER BY i) AS y FROM (SELECT part, best[2] AS e, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS m FROM near{i}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) GROUP BY ALL) GROUP BY ALL),
book{i + 1} AS (SELECT b.part, b.e, coalesce(m.y, b.y) AS y FROM book{i} b LEFT JOIN means{i} m USING (part, e))""")
    steps.append(f"""last AS ({near.format(book=f"book{rounds}")}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM last GROUP BY ALL)""")
    return f"""WITH {", ".join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
(SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) FROM book{rounds}) AS codebooks_sha256 FROM coded"""
