"""Mixing sources to target weights: a tempered share for each source, realised as permutations under a token budget.

Weights are shares of tokens to a power a between 0 and 1, normalised. The entropy of the weights grows and the
largest number of repetitions worsens as a falls, so both limits are met by bisection; every round evaluates a grid of
exponents in one aggregate over the table of sources, which stays in Spark.

A source with quota q and t tokens is read floor(q / t) times in full and once in part. Each reading is a keyed
permutation: an order of hash blocks, and of hashes within a block. The part ends in the block where the running sum
of whole blocks passes the rest of the quota, at the last document that still fits. Running sums go over groups of blocks,
then over the blocks of one group, so no task has more than a source's groups. What decides about a document is
its own hash and one row about its source, so no text is shuffled, however large a source is.

Defined cases: a null source is a source of its own; a null or blank text has no tokens and comes along wherever its
hash falls; a source without tokens has weight 0 and is left out; documents that repeat an id have the same hash and
are taken or left together; a text of any length is one row; no rows give no rows. Other columns may have any name but
__source, __weight, __full, __blocks, __cut_block, __cut_place and __n; those that ``mix`` adds replace any of their name.

Tokens are words between white space, or what the column ``tokens_col`` says (null: none), such as the counts of
``tokens.count_tokens``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored

#: Tokens in a block of a permutation, and the most sources of a broadcast (about 100 bytes each).
BLOCK_TOKENS = 1_000_000
MAX_SOURCES = 100_000
GRID, PASSES = 33, 6
WORD = r"[^\x20\x09-\x0D]+"
_UNITS = 1 << 40
#: Blocks of a group.
GROUP = 4096
#: What a sample has besides its rows' own columns.
ADDED = ("mix_weight", "mix_epoch", "mix_block", "mix_slot")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponent(sources: DataFrame, budget: float, entropy_gain: float, max_repeat: float) -> float:
    """The largest exponent whose weights reach the entropy, if no document is then read over ``max_repeat`` times;
    else the least exponent that keeps to that limit (1 if none does).

    The entropy wanted lies ``entropy_gain`` of the way from that of the shares themselves to that of equal weights.
    """
    total, kinds, least = sources.agg(F.sum("tokens"), F.count("*"), F.min("tokens")).first()
    if not total or kinds < 2:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def measure(grid: list[float]) -> list[tuple[float, float]]:
        """Entropy and largest repetition at each exponent. Repetition is largest for the smallest source."""
        each = sources.select(share.alias("p"), F.posexplode(F.array(*map(F.lit, grid))).alias("i", "a"))
        power = F.pow("p", "a")
        sums = {r["i"]: (r["z"], r["s"]) for r in each.groupBy("i").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("s")).collect()}
        out = []
        for i, a in enumerate(grid):
            z, s = sums[i]
            out.append((math.log(z) - a * s / z, (least / total) ** (a - 1) / z * budget / total))
        return out

    (even, _), (own, _) = measure([0.0, 1.0])
    wanted = own + entropy_gain * (even - own)
    spans = [(0.0, 1.0), (0.0, 1.0)]  # of the entropy's edge, which holds below it, and of the limit's, which holds above
    for _ in range(PASSES):
        grids = [[low + (high - low) * i / (GRID - 1) for i in range(GRID)] for low, high in spans]
        found = measure([a for grid in grids for a in grid])
        up = max((i for i, (h, _) in enumerate(found[:GRID]) if h >= wanted), default=0)
        down = min((i for i, (_, r) in enumerate(found[GRID:]) if r <= max_repeat), default=GRID - 1)
        spans = [(grids[0][up], grids[0][min(up + 1, GRID - 1)]), (grids[1][max(down - 1, 0)], grids[1][down])]
    return max(spans[0][0], spans[1][1])


def hashed(key: str, epoch: Column, name: Column) -> Column:
    """A place in [0, 2^40) for a document in one reading."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), epoch.cast("string"), name)), 1, 10), 16, 10).cast("long")


def block_of(place: Column, blocks: Column) -> Column:
    return F.floor(place.cast("double") / _UNITS * blocks).cast("long")


def stops(sums: DataFrame, by: str) -> DataFrame:
    """(source, by, before): where the running sum of n over ``by``, after ``before``, first passes a source's rest, and
    the sum before it; no row for a source that has no such place."""
    order = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = sums.withColumn("upto", F.sum("n").over(order) + F.col("before")).where("upto > rest")
    first = passed.groupBy("source").agg(F.min(F.struct(by, (F.col("upto") - F.col("n")).alias("before"))).alias("x"))
    return first.select("source", f"x.{by}", "x.before")


def plan(docs: DataFrame, budget_share: float = 1.0, entropy_gain: float = 0.5, max_repeat: float = 4.0, key: str = "mix", source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per source: tokens, weight, full readings, and where the last reading ends."""
    size = F.coalesce(F.col(tokens_col), F.lit(0)).cast("long") if tokens_col else n_tokens(F.col(text_col))
    own = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("string").alias("name"), size.alias("n"))
    own = stored(own, "sizes")  # three narrow columns: the words of a text are counted once
    # a row per source: few files, as the bisection reads them again and again
    sources = stored(own.groupBy("source").agg(F.sum("n").alias("tokens")).where("tokens > 0").coalesce(8), "sources")
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = budget_share * total
    a = exponent(sources, budget, entropy_gain, max_repeat)
    power = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a))
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    quota = F.col("weight") * budget
    shares = sources.withColumn("weight", power / norm).withColumn("full", F.floor(quota / F.col("tokens") + 1e-9).cast("long"))
    shares = shares.withColumn("rest", F.greatest(F.lit(0.0), quota - F.col("full") * F.col("tokens")))
    shares = shares.withColumn("blocks", F.ceil(F.col("tokens") / block_tokens).cast("double"))
    small = sources.count() <= MAX_SOURCES
    about = F.broadcast(shares) if small else shares
    placed = own.join(about, own.source.eqNullSafe(shares.source)).drop(shares.source).withColumn("place", hashed(key, F.col("full"), F.col("name")))
    placed = placed.withColumn("block", block_of(F.col("place"), F.col("blocks")))
    sums = placed.groupBy("source", "block", "rest").agg(F.sum("n").alias("n")).withColumn("group", F.floor(F.col("block") / GROUP))
    groups = stops(sums.groupBy("source", "group", "rest").agg(F.sum("n").alias("n")).withColumn("before", F.lit(0).cast("long")), "group")
    groups = groups.select(F.col("source").alias("s"), F.col("group").alias("g"), "before")
    within_group = sums.join(F.broadcast(groups) if small else groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g"))).drop("s", "g")
    last = stops(within_group, "block").select("source", F.col("block").alias("cut_block"), "before")
    # the rows of the last block of a source: bounded by the block's tokens
    edge = placed.select("source", "block", "place", "n", "rest").alias("p").join(
        (F.broadcast(last) if small else last).alias("l"), F.expr("p.source <=> l.source and p.block = l.cut_block")
    ).select("p.source", "place", "n", "rest", "before")
    within = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = edge.withColumn("upto", F.sum("n").over(within) + F.col("before")).where("upto <= rest").groupBy("source").agg(F.max("place").alias("cut_place"))
    out = shares.alias("s").join(last.alias("l"), F.expr("s.source <=> l.source"), "left").join(fits.alias("f"), F.expr("s.source <=> f.source"), "left")
    return stored(out.select("s.*", F.coalesce("cut_block", F.lit(-1 << 40)).alias("cut_block"), F.coalesce("cut_place", F.lit(-1)).alias("cut_place")), "mix-plan")


def mix(docs: DataFrame, key: str = "mix", source_col: str = "source", id_col: str = "doc_id", **limits) -> DataFrame:
    """``docs`` as sampled, a row per reading, with mix_weight, mix_epoch, mix_block and mix_slot. To read in the order
    of the permutation, order by the last three."""
    found = plan(docs, key=key, source_col=source_col, id_col=id_col, **limits)
    about = found.select(*(F.col(c).alias(f"__{c}") for c in ("source", "weight", "full", "blocks", "cut_block", "cut_place")))
    about = F.broadcast(about) if found.count() <= MAX_SOURCES else about
    name = F.col(id_col).cast("string")
    joined = docs.join(about, F.col(source_col).cast("string").eqNullSafe(F.col("__source")))
    place = hashed(key, F.col("__full"), name)
    block = block_of(place, F.col("__blocks"))
    part = (block < F.col("__cut_block")) | ((block == F.col("__cut_block")) & (place <= F.col("__cut_place")))
    copies = F.col("__full") + F.when(part, 1).otherwise(0)
    out = joined.withColumn("__n", copies).where("__n > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    out = out.withColumn("mix_slot", hashed(key, F.col("mix_epoch"), name)).withColumn("mix_block", block_of(F.col("mix_slot"), F.col("__blocks")))
    return out.withColumn("mix_weight", F.col("__weight")).select(*(c for c in docs.columns if c not in ADDED), *ADDED)


def sql(docs: str, budget_share: float, entropy_gain: float, max_repeat: float, key: str = "mix", block_tokens: int = BLOCK_TOKENS) -> str:
    """The same sample in SQL, for a table with the default column names."""

    def edge(name: str, keeps: str, below: bool) -> str:
        """The same bisection: a recursive table of (pass, low, high), each pass measuring a grid of exponents."""
        pick = "max" if below else "min"
        low, high = ("edge", "least(edge + 1, 32)") if below else ("greatest(edge - 1, 0)", "edge")
        return f"""{name} AS (SELECT 0 AS pass, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL
      SELECT pass + 1, low + (high - low) * ({low}) / 32.0, low + (high - low) * ({high}) / 32.0 FROM (
        SELECT pass, low, high, coalesce({pick}(i) FILTER (WHERE {keeps}), {0 if below else 32}) AS edge FROM (
          SELECT pass, low, high, i, ln(z) - a * s / z AS h, pow(least_tokens / total, a - 1) / z * {budget_share}::DOUBLE AS r FROM (
            SELECT pass, low, high, i, low + (high - low) * i / 32.0 AS a, any_value(total) AS total, any_value(least_tokens) AS least_tokens,
              sum(pow(tokens / total, low + (high - low) * i / 32.0)) AS z, sum(pow(tokens / total, low + (high - low) * i / 32.0) * ln(tokens / total)) AS s
            FROM {name}, generate_series(0, 32) AS g(i), shares GROUP BY ALL))
        GROUP BY ALL) WHERE pass < {PASSES})"""

    place = lambda epoch: f"('0x' || substr(md5(concat_ws('|', '{key}', {epoch}::VARCHAR, doc_id::VARCHAR)), 1, 10))::BIGINT"
    return rf"""
    WITH RECURSIVE own AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS n FROM {docs}),
    sources AS (SELECT source, sum(n)::DOUBLE AS tokens FROM own GROUP BY 1 HAVING sum(n) > 0),
    shares AS (SELECT tokens, (SELECT sum(tokens) FROM sources) AS total, (SELECT min(tokens) FROM sources) AS least_tokens FROM sources),
    goal AS (SELECT own_h + {entropy_gain} * (ln(kinds) - own_h) AS wanted FROM (SELECT -sum(tokens / total * ln(tokens / total)) AS own_h, count(*) AS kinds FROM shares)),
    {edge("by_entropy", "h >= (SELECT wanted FROM goal)", True)},
    {edge("by_repeat", f"r <= {max_repeat}", False)},
    chosen AS (SELECT greatest((SELECT low FROM by_entropy WHERE pass = {PASSES}), (SELECT high FROM by_repeat WHERE pass = {PASSES})) AS a),
    weights AS (SELECT source, tokens, pow(tokens / total, a) / sum(pow(tokens / total, a)) OVER () AS weight, total FROM sources, (SELECT any_value(total) AS total FROM shares), chosen),
    quotas AS (SELECT *, floor(weight * total * {budget_share} / tokens + 1e-9)::BIGINT AS times, ceil(tokens / {block_tokens}) AS blocks FROM weights),
    rests AS (SELECT *, greatest(0, weight * total * {budget_share} - times * tokens) AS rest FROM quotas),
    placed AS (SELECT own.*, weight, times, blocks, rest, {place("times")} AS place FROM own JOIN rests ON own.source IS NOT DISTINCT FROM rests.source),
    blocked AS (SELECT *, floor(place::DOUBLE / {_UNITS} * blocks)::BIGINT AS block FROM placed),
    running AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY block, place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM (SELECT source, block, place, sum(n) AS n, any_value(rest) AS rest FROM blocked GROUP BY 1, 2, 3)),
    last AS (SELECT source, min((block, place)) AS stop FROM running WHERE upto > rest GROUP BY 1),
    copies AS (SELECT b.*, times + CASE WHEN (block, place) < stop THEN 1 ELSE 0 END AS copies FROM blocked b LEFT JOIN last l ON b.source IS NOT DISTINCT FROM l.source),
    epochs AS (SELECT *, unnest(generate_series(0, copies - 1)) AS mix_epoch FROM copies WHERE copies > 0)
    SELECT doc_id, source, round(weight, 6) AS mix_weight, mix_epoch, floor({place("mix_epoch")}::DOUBLE / {_UNITS} * blocks)::BIGINT AS mix_block, {place("mix_epoch")} AS mix_slot FROM epochs
    """
