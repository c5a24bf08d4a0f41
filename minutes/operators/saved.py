"""Saved queries as a table: which texts match which of any number of queries.

A group of terms (of those joined by OR) can only hold where every positive term does. Texts are read where they lie, and
nothing of them is shuffled: an index of up to ``IN_PLACE`` alternatives goes to every task, and more queries than that make as
many passes (up to ``PASSES``), one with each index. An alternative is looked up by the window it begins with, up to ``WINDOW``
characters, and counted in the text. A group is looked at where an alternative of one of its terms occurs, that which the
fewest others have, and then held against the counts.

Beyond that, queries stay where they lie too. A group is indexed under one of its terms, and that under a single gram of
each of its alternatives: the rarest over the texts. Texts are read twice: to count the grams that queries ask for, and to
find the texts that have the chosen ones; a bitmap of bounded size tells a task which grams those are. Texts and queries
then meet by gram, in parts where a gram is in many texts, and what meets is verified in the engine. Neither queries nor texts
come to the driver. What meets may be many times what matches.

Both ways have the rules of ``search``, so the results are the same. Groups
without a positive term have nothing to be found by. They are held against all texts, as their matches are most of them.

Defined cases: a null or empty query matches every text with score 0; queries that repeat an id count each; a null normal form
is empty; texts that repeat an id are matched each; ids of texts may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import narrow, stored
from .grams import SIZES, code_points, keys, term_keys
from .search import MATCHES, compile_query

#: Alternatives whose index is small enough to go to every task (some 100 bytes each), and so many passes over the texts at most.
IN_PLACE, PASSES = 2_000_000, 16
#: Characters of an alternative that it is looked up by; flags of windows at most.
WINDOW, FLAGS = 8, 1 << 25
#: Bits of the map of grams for each of them, and in all (16 MB).
BITS_EACH, BITS = 64, 1 << 27
#: Texts of a part of a gram.
PART = 100_000
#: Stands for the gram of groups without a positive term.
ANY = -1
_GROUPS = "array<array<struct<negative: boolean, alternatives: array<string>>>>"
_INDEX = "array<array<array<array<bigint>>>>"


def compiled(saved: DataFrame, dictionaries: dict | None = None) -> DataFrame:
    """(at, query_id, groups) of (query_id, query)."""
    rows = saved.select("query_id", F.col("query").cast("string").alias("query")).withColumn("at", F.monotonically_increasing_id())
    known = dictionaries or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("negative", pa.bool_()), ("alternatives", pa.list_(pa.string()))])))
        for batch in batches:
            made = [compile_query(q or "", **known) for q in batch.column("query").to_pylist()]
            groups = [[[{"negative": t.negative, "alternatives": list(t.alternatives)} for t in g] for g in q] for q in made]
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("query_id"), pa.array(groups, kind)], ["at", "query_id", "groups"])

    # dealt anew, as a table of queries is small for the work on it
    dealt = rows.repartition(saved.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, f"at long, query_id {dict(rows.dtypes)['query_id']}, groups {_GROUPS}")


def with_grams(queries: DataFrame) -> DataFrame:
    """(at, grams): grams of each group, positive term and alternative."""
    positive = F.transform("groups", lambda g: F.transform(F.filter(g, lambda t: ~t["negative"]), lambda t: t["alternatives"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [[[[sorted(term_keys(a)) for a in t] for t in g] for g in q] for q in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(grams, pa.list_(pa.list_(pa.list_(pa.list_(pa.int64())))))], ["at", "grams"])

    return queries.select("at", positive.alias("terms")).mapInArrow(run, f"at long, grams {_INDEX}")


def bitmap(grams: DataFrame, count: int) -> np.ndarray:
    """Bits at the remainders of grams by their number."""
    size = min(BITS, max(64, 1 << (BITS_EACH * count).bit_length()))
    at = grams.select(F.pmod("gram", F.lit(size - 1)).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def asked_grams(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """``texts`` (with column __norm) without it, and a row for each of its grams (gram) that the map has."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)
    rest = [c for c in texts.columns if c != "__norm"]
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = sent.value
        for batch in batches:
            found = []
            for text in batch.column("__norm").to_pylist():
                codes = code_points(text)
                own = np.concatenate([keys(codes, s) for s in SIZES])
                at = own % (64 * len(have) - 1)
                found.append(own[(have[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found, pa.list_(pa.int64()))], [*rest, "grams"])

    listed = texts.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "grams array<long>"]))
    return listed.select(*rest, F.explode("grams").alias("gram"))


def holds(norm: Column, group: Column) -> Column:
    return F.forall(group, lambda t: t["negative"] != F.exists(t["alternatives"], lambda a: norm.contains(a)))


def score(norm: Column, groups: Column) -> Column:
    """As ``search.hit_score``, of queries in a column: the best group that holds; null if there are groups and none does."""
    times = lambda a: ((F.length(norm) - F.length(F.replace(norm, a, F.lit("")))) / F.length(a)).cast("int")
    first = lambda t: F.coalesce(times(F.get(F.filter(t["alternatives"], lambda a: norm.contains(a)), F.lit(0))), F.lit(0))
    total = lambda g: F.aggregate(F.filter(g, lambda t: ~t["negative"]), F.lit(0), lambda s, t: s + first(t))
    best = F.array_max(F.transform(F.filter(groups, lambda g: holds(norm, g)), total))
    return F.when(F.size(groups) == 0, 0).otherwise(best)


class Index(NamedTuple):
    """Distinct alternatives by the windows they begin with; flat lists with where each part of them begins."""

    names: pa.Array  # ids of queries
    texts: pa.Array  # distinct alternatives
    sizes: tuple[int, ...]  # of windows
    keys: np.ndarray  # of windows, distinct, ascending
    map: np.ndarray  # flags at the remainders of keys
    key_starts: np.ndarray  # of each key, in begun
    begun: np.ndarray  # places in texts
    led_starts: np.ndarray  # of each text, in led
    led: np.ndarray  # groups whose leading term has the text
    group_starts: np.ndarray  # of each group, in terms
    term_starts: np.ndarray  # of each term, in own
    own: np.ndarray  # alternatives of each term in order, as places in texts
    negative: np.ndarray  # of each term
    query_of: np.ndarray  # of each group, ascending


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A number for every stretch of ``size`` of the last axis; other stretches seldom have the same."""
    n = max(codes.shape[-1] - size + 1, 0)
    out = np.full((*codes.shape[:-1], n), size, np.uint64)
    for k in range(size):
        out = (out ^ codes[..., k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def index_of(entries: pa.Table, names: pa.Table) -> Index:
    """Of (at, group, term, alternative, negative, text), a row for each alternative, and of (at, query_id)."""
    names = names.sort_by("at")
    entries = entries.take(np.lexsort([entries.column(c).to_numpy() for c in ("alternative", "term", "group", "at")]))
    at, group, term = (entries.column(c).to_numpy() for c in ("at", "group", "term"))
    coded = entries.column("text").combine_chunks().dictionary_encode()
    texts, own = coded.dictionary, coded.indices.to_numpy()
    differs = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
    new_group = differs(at) | differs(group)
    term_starts = np.flatnonzero(new_group | differs(term))
    first_terms = np.flatnonzero(new_group[term_starts])
    negative = entries.column("negative").to_numpy(zero_copy_only=False)[term_starts]
    # a group is found by the positive term whose alternatives the fewest others have
    shared = np.bincount(own, minlength=len(texts))
    cost = np.where(negative, np.iinfo(np.int64).max, np.add.reduceat(shared[own], term_starts))
    group_of = np.cumsum(new_group[term_starts]) - 1
    lead = np.lexsort([cost, group_of])[first_terms]
    places, begins = _stretches(np.append(term_starts, len(own)), lead)
    led_by, led = own[places], np.repeat(np.arange(len(lead)), np.diff(np.append(begins, len(places))))
    by_text = np.argsort(led_by, kind="stable")
    # windows that alternatives begin with
    sizes = np.minimum(pc.utf8_length(texts).to_numpy(), WINDOW)
    keys = np.zeros(len(texts), np.uint64)
    for size in np.unique(sizes):
        begun = np.flatnonzero(sizes == size)
        heads = "".join(pc.utf8_slice_codeunits(texts.take(pa.array(begun)), 0, int(size)).to_pylist())
        keys[begun] = windows(code_points(heads).reshape(-1, size), int(size))[:, 0]
    distinct, key_of = np.unique(keys, return_inverse=True)
    by_key = np.argsort(key_of, kind="stable")
    flags = np.zeros(min(FLAGS, 1 << (16 * len(distinct)).bit_length()), bool)
    flags[distinct & np.uint64(len(flags) - 1)] = True
    small = lambda x: x.astype(np.int32)
    return Index(
        names.column("query_id").combine_chunks(), texts, tuple(map(int, np.unique(sizes))), distinct, flags,
        small(np.searchsorted(key_of[by_key], np.arange(len(distinct) + 1))), small(by_key),
        small(np.searchsorted(led_by[by_text], np.arange(len(texts) + 1))), small(led[by_text]),
        small(np.append(first_terms, len(term_starts))), small(np.append(term_starts, len(own))), small(own), negative,
        small(np.searchsorted(names.column("at").to_numpy(), at[term_starts[first_terms]])),
    )


def _stretches(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the stretches ``which`` of a flat list, and where each of these begins among them."""
    sizes = starts[which + 1].astype(np.int64) - starts[which]
    begins = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts[which] - begins, sizes), begins


def matches(index: Index, text: str, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The queries that match a text, and their scores; ``count``: a number for each alternative, all zero."""
    codes = code_points(text)
    found = np.concatenate([windows(codes, s) for s in index.sizes])
    found = found[index.map[found & np.uint64(len(index.map) - 1)]]
    at = np.minimum(np.searchsorted(index.keys, found), len(index.keys) - 1)
    begun = index.begun[_stretches(index.key_starts, np.unique(at[index.keys[at] == found]))[0]]
    n = np.array([text.count(a) for a in index.texts.take(pa.array(begun)).to_pylist()], np.int32)
    begun, n = begun[n > 0], n[n > 0]
    groups = np.unique(index.led[_stretches(index.led_starts, begun)[0]])
    if not len(groups):
        return np.empty(0, np.int32), np.empty(0, np.int32)
    count[begun] = n
    terms, of_group = _stretches(index.group_starts, groups)
    own, of_term = _stretches(index.term_starts, terms)
    times = count[index.own[own]]
    count[begun] = 0
    # a term counts its first alternative that occurs
    first = np.minimum.reduceat(np.where(times > 0, np.arange(len(times)), len(times)), of_term)
    hits, negative = np.append(times, 0)[first], index.negative[terms]
    holds = np.logical_and.reduceat((hits > 0) != negative, of_group)
    scores = np.add.reduceat(np.where(negative, 0, hits), of_group)[holds]
    queries = index.query_of[groups[holds]]
    if not len(queries):
        return queries, scores
    new = np.flatnonzero(np.diff(queries, prepend=-1))
    return queries[new], np.maximum.reduceat(scores, new)


def matched_in_place(texts: DataFrame, queries: DataFrame, id_cols: list[str]) -> DataFrame:
    """(query_id, …id_cols, score) of ``texts`` (with column __norm) and as many queries as one index may have."""
    # a positive term without alternatives holds nowhere
    can = F.filter("groups", lambda g: ~F.exists(g, lambda t: ~t["negative"] & (F.size(t["alternatives"]) == 0)))
    group = queries.select("at", F.posexplode(can).alias("group", "g"))
    term = group.select("at", "group", F.posexplode("g").alias("term", "t"))
    entries = term.select("at", "group", "term", F.col("t.negative").alias("negative"), F.posexplode("t.alternatives").alias("alternative", "text")).toArrow()
    kinds = dict(texts.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in ["query_id", *id_cols]), "score int"])
    if not entries.num_rows:
        return texts.sparkSession.createDataFrame([], schema)
    sent = texts.sparkSession.sparkContext.broadcast(index_of(entries, queries.select("at", "query_id").toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        count = np.zeros(len(index.texts), np.int32)

        def rows(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
            at, queries, scores = (np.concatenate([np.empty(0, np.int32), *x]).astype(np.int32) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int32)] * 3
            kept = [batch.column(c).take(pa.array(at)) for c in id_cols]
            return pa.RecordBatch.from_arrays([index.names.take(pa.array(queries)), *kept, pa.array(scores)], ["query_id", *id_cols, "score"])

        for batch in batches:
            found, n = [], 0
            for row, text in enumerate(batch.column("__norm")):
                queries, scores = matches(index, text.as_py(), count)
                found.append((np.full(len(queries), row, np.int32), queries, scores))
                n += len(queries)
                if n >= MATCHES:
                    yield rows(batch, found)
                    found, n = [], 0
            yield rows(batch, found)

    return texts.mapInArrow(run, schema)


def met_by_shuffle(texts: DataFrame, entries: DataFrame, id_cols: list[str], part: int) -> DataFrame:
    """The same for any number of queries: each group under the rarest gram of one of its terms."""
    entry = entries.select("at", "group", "term", "alternative", F.explode("grams").alias("gram"))
    wanted = stored(entry.select("gram").distinct(), "grams")
    counts = stored(asked_grams(texts, bitmap(wanted, wanted.count())).join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n")), "counts")
    rated = entry.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("at", "group", "term", "alternative").agg(F.min(F.struct("n", "gram")).alias("x"))
    # the positive term of a group with the fewest texts over its alternatives
    terms = rarest.groupBy("at", "group", "term").agg(F.sum("x.n").alias("n"), F.collect_set("x").alias("xs"))
    best = terms.groupBy("at", "group").agg(F.min(F.struct("n", "term", "xs")).alias("b"))
    index = stored(best.select("at", F.explode("b.xs").alias("x")).select("at", "x.gram", "x.n").where("n > 0").distinct(), "index")
    chosen = index.select("gram", "n").distinct()
    # texts with the chosen grams, each gram in parts
    found = asked_grams(texts, bitmap(chosen, chosen.count()))
    large = chosen.where(F.col("n") > part).select("gram", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    one = F.coalesce("parts", F.lit(1))
    split = lambda df: df.join(narrow(large), "gram", "left")
    left = split(found).withColumn("part", F.pmod(F.xxhash64(*id_cols), one).cast("int")).drop("parts")
    right = split(index).select("at", "gram", F.explode(F.sequence(F.lit(0), one - 1)).alias("part"))
    named = {c: f"__{i}" for i, c in enumerate(id_cols)}
    pairs = left.join(right, ["gram", "part"]).select("at", *(F.col(c).alias(n) for c, n in named.items())).distinct()
    return texts.join(pairs, [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()]).drop(*named.values())


def search_saved(speeches: DataFrame, saved: DataFrame, id_cols: list[str], norm_col: str = "norm", dictionaries: dict | None = None, part: int = PART, in_place: int = IN_PLACE) -> DataFrame:
    """(query_id, …id_cols, score) of all matches of ``saved`` (query_id, query)."""
    queries = stored(compiled(saved, dictionaries), "saved")
    texts = speeches.select(*id_cols, F.coalesce(norm_col, F.lit("")).alias("__norm"))
    # queries with a group that has nothing to be found by are held against all texts, and by nothing else
    is_free = (F.size("groups") == 0) | F.exists("groups", lambda g: F.forall(g, lambda t: t["negative"]))
    free, found = queries.where(is_free), queries.where(~is_free)
    size = found.agg(F.coalesce(F.sum(F.aggregate(F.flatten("groups"), F.lit(0), lambda s, t: s + F.size(t["alternatives"]))), F.lit(0))).first()[0]
    cols = ["query_id", *id_cols, "score"]
    verified = lambda met: met.withColumn("score", score(F.col("__norm"), F.col("groups"))).where(F.col("score").isNotNull()).select(*cols)
    if size <= in_place * PASSES:
        passes = max(1, -(-size // max(in_place, 1)))
        out = [matched_in_place(texts, found.where(F.pmod(F.xxhash64("at"), F.lit(passes)) == k), id_cols) for k in range(passes)]
    else:
        # where a group can be found: (at, group, term, alternative, grams)
        group = with_grams(found).select("at", F.posexplode("grams").alias("group", "g"))
        term = group.select("at", "group", F.posexplode("g").alias("term", "t"))
        entries = term.select("at", "group", "term", F.posexplode("t").alias("alternative", "grams"))
        asked = found.select(F.col("at").alias("__at"), "query_id", "groups")
        out = [verified(met_by_shuffle(texts, entries, id_cols, part).join(narrow(asked), F.col("at") == F.col("__at")))]
    if free.limit(1).count():  # queries that say only what must not be there
        out.append(verified(texts.crossJoin(narrow(free.select("query_id", "groups")))))
    return reduce(DataFrame.unionByName, out)
