"""Connected components of a distributed edge table by alternating large and small stars.

Edges go from a node to a smaller one. Each round moves every edge's end to the least node around that end, then ties a
node's several ends to the least of them; after a number of rounds that grows with the logarithm of the longest chain
every component is a star at its least node. A round is written to shared storage with a mark on every edge that it
moved; the driver sees one flag, and rounds end when no edge has moved, which is exact. A hub has many edges but one
row in what they are joined with, so such a join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), the root being the least node of its component; no edges (or
    loops alone) give no rows, repeated edges count once, an edge with a null end is left out."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    moving = not now.isEmpty()
    while moving:
        # an end that has smaller neighbours itself gives way to the least of them
        least = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = now.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
        large = large.groupBy("a", "b").agg(F.max("moved").alias("moved"))
        first = large.groupBy("a").agg(F.min("b").alias("m"), F.max("moved").alias("moved"))
        tied = large.join(first.select("a", "m"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        both = tied.unionByName(first.select("a", F.col("m").alias("b"), "moved"))
        now = stored(both.groupBy("a", "b").agg(F.max("moved").alias("moved")), "edges")
        moving = now.agg(F.max("moved")).first()[0]
        now = now.drop("moved")
    star = now.select("a", "b").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
