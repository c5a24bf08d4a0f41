"""Ranked retrieval: BM25 over stored normal forms, and the fusion of several rankings.

A term is a list of alternatives, as in the search; its frequency in a text is that of its first alternative that occurs.
Terms come from a query, or from a question in running text as its character n-grams, which need no word boundaries. One
pass counts texts, their length and each term's texts, in one row; the second scores. Both stay in the engine.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import normalize_term
from .search import compile_query, occurrences

#: Saturation of a term's frequency, and how far a text's length counts.
K1, B = 1.2, 0.75
#: What is added to a rank before its reciprocal counts.
RANK_BASE = 60


def query_terms(query: str, dictionaries: dict | None = None) -> list[list[str]]:
    """The alternatives of each positive term of a query, whatever its group."""
    found = (t.alternatives for g in compile_query(query, **(dictionaries or {})) for t in g if not t.negative and t.alternatives)
    return [list(a) for a in dict.fromkeys(found)]


def gram_terms(question: str, n: int = 2, variants: dict[str, str] | None = None) -> list[list[str]]:
    """The distinct n-grams of a question's normal form; a shorter one is a term itself."""
    norm = normalize_term(question, variants)
    return [[g] for g in dict.fromkeys(norm[i : i + n] for i in range(max(1, len(norm) - n + 1))) if g]


def frequency(norm: Column, alternatives: list[str]) -> Column:
    """How often the first alternative that occurs does."""
    out = F.when(F.lit(False), F.lit(0))
    for a in alternatives:
        out = out.when(norm.contains(F.lit(a)), occurrences(norm, a))
    return F.coalesce(out, F.lit(0))


def bm25(speeches: DataFrame, terms: list[list[str]], norm_col: str = "norm", k1: float = K1, b: float = B) -> DataFrame:
    """``speeches`` with any of the terms, with column bm25. A null normal form is empty, but counts as a text.

    The weight of a term in n of N texts is ln(1 + (N - n + 0.5) / (n + 0.5)). Without terms there are no rows.
    """
    norm = F.coalesce(norm_col, F.lit(""))
    tf = F.array(*(frequency(norm, t) for t in terms)) if terms else F.array().cast("array<int>")
    own = speeches.withColumn("__tf", tf).withColumn("__length", F.length(norm))
    seen = [F.count_if(F.col("__tf")[i] > 0).alias(f"__n{i}") for i in range(len(terms))]
    totals = own.agg(F.count("*").alias("__texts"), F.avg("__length").alias("__mean"), *seen)
    every = own.where(F.exists("__tf", lambda n: n > 0)).crossJoin(F.broadcast(totals))  # a single row
    long = 1 - b + b * F.col("__length") / F.col("__mean")
    weight = lambda i: F.log1p((F.col("__texts") - F.col(f"__n{i}") + 0.5) / (F.col(f"__n{i}") + 0.5))
    part = lambda i: F.when(F.col("__tf")[i] > 0, weight(i) * F.col("__tf")[i] * (k1 + 1) / (F.col("__tf")[i] + k1 * long)).otherwise(0.0)
    score = reduce(add, map(part, range(len(terms))), F.lit(0.0))
    return every.withColumn("bm25", score).select(*speeches.columns, "bm25")


def top(scored: DataFrame, id_col: str, score_col: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, rank): the k best, ties by id; all of them are left out of sorts but the k best (of each ``by``)."""
    order = [F.desc(score_col), F.asc(id_col)]
    if by:
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return ranked.where(F.col("rank") <= k).select(*by, id_col, "rank")
    best = scored.select(id_col, score_col).orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(id_col, "rank")  # over k rows


def fuse(rankings: dict[str, DataFrame], id_col: str, k: int, by: tuple[str, ...] = (), base: int = RANK_BASE) -> DataFrame:
    """(by, id, rank_<name> of each ranking or null, fused, rank): the k best by the sum of reciprocal ranks.

    rankings: (by, id, rank) by name, each of bounded length. Ties are settled by id.
    """
    tagged = [df.select(*by, id_col, F.lit(name).alias("__name"), "rank") for name, df in rankings.items()]
    both = reduce(DataFrame.unionByName, tagged)
    ranks = [F.max(F.when(F.col("__name") == name, F.col("rank"))).alias(f"rank_{name}") for name in rankings]
    # reciprocals are added in the order of the rankings, so that equal ranks give equal sums
    total = reduce(add, (F.coalesce(1 / (base + F.col(f"rank_{name}")), F.lit(0.0)) for name in rankings))
    fused = both.groupBy(*by, id_col).agg(*ranks).withColumn("fused", total)
    window = Window.partitionBy(*by) if by else Window.partitionBy()  # without ``by``: a few times the length of a ranking
    return fused.withColumn("rank", F.row_number().over(window.orderBy(F.desc("fused"), F.asc(id_col)))).where(F.col("rank") <= k)


def hybrid(speeches: DataFrame, terms: list[list[str]], near: DataFrame, k: int = 20, id_col: str = "sid", depth: int = 100) -> DataFrame:
    """The k best of keywords (BM25) and vectors (near: id, rank, already the best of a vector search) for one question."""
    words = top(bm25(speeches, terms), id_col, "bm25", depth)
    return fuse({"word": words, "vector": near.select(id_col, "rank")}, id_col, k)
