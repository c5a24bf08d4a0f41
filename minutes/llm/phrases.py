"""Phrase collocations by contiguous pattern growth: prefixes, their projected occurrences, and what follows them.

Texts are cut into pieces, which no phrase crosses, and pieces into words. Words are counted first; rare ones end pieces
too, as no frequent phrase holds one (a bitmap of the hashes of frequent words, of bounded size, tells most of them). Then
every place where a word stands is an occurrence of a prefix, and what follows it within its piece, up to the greatest length, is all that
growing the prefix to the right will ever need: these projected occurrences are sent to one task for each prefix, where
the recursion runs depth-first: occurrences are dealt by their next word, a phrase that is found often enough is handed
on, and its own occurrences are grown further; one that is not is left with all that begins with it.

A task that reads texts sorts its occurrences, so equal ones are sent once with their number, and all of a prefix as one
row. The commonest words (at least one word in SHARE, so at most SHARE of them) are not left to one task: their
occurrences are split by a hash of the word behind, into as many parts as they have shares. A task that holds more than ``hold`` different occurrences of a prefix hands
on what it has counted and begins anew; partial counts are added up and held against the limit afterwards. So no prefix
has to fit into memory, and no phrase is lost.

A phrase's score is the least, over the places where it can be cut in two, of a * a / (left * right): how much more often
the parts stand together than they could by their own numbers alone. Parts of a frequent phrase are frequent, so all
numbers needed are at hand, and they are joined; arithmetic is on decimals of 38 digits, exact for numbers up to 9e15. The
best of a language are found in rounds, each over groups of bounded size, so a language may hold most phrases.

Defined cases: a null text is empty, a null language is ``und``; a text of any length is read whole, in pieces that overlap by
a phrase; repeated rows count each; ids are not read; a text without words adds nothing; an empty table gives no rows.
Only the language and the text are read, under names of their own, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import narrow
from .common import slices, stored, utf8

#: A word this common (one in SHARE of all) is split by the word behind it; a longer one than LONGEST bytes never is.
SHARE, LONGEST = 2000, 256
#: Tokens a task gathers before it hands its occurrences on; different occurrences of a prefix that its task holds.
GATHER, HOLD = 1_000_000, 1_000_000
#: Bits of the map of frequent words for each of them, and in all (16 MB).
BITS_EACH, BITS = 32, 1 << 27
#: Phrases of a group, when the best of a language are found.
GROUP = 20_000
# The characters that end a piece, and those between words.
_CUT = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")
END = b"\n"


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case, and END between pieces."""
    return [t for t in text.lower().translate(_CUT).replace(b"\n", b" \n ").split(b" ") if t]


class Numbers(dict):
    """A number for each word, in the order they are met; END is 0."""

    def __init__(self) -> None:
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def gathered(batches: Iterator[pa.RecordBatch], overlap: int, most: int) -> Iterator[tuple[str, list[bytes], np.ndarray, int]]:
    """(language, words by number, numbers of a stretch of texts, of which so many begin an occurrence), each of about
    ``most`` tokens. A text that is longer goes over several, each with the first words of the next behind it."""
    held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
    size = 0

    def all_of() -> Iterator[tuple[str, list[bytes], np.ndarray, int]]:
        for lang, (numbers, parts) in held.items():
            ids = np.concatenate(parts)
            yield lang, list(numbers), ids, len(ids)

    for batch in slices(batches, "text", 4 << 20):
        for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
            own = tokens(text)
            if len(own) > most:
                for a in range(0, len(own), most):
                    part = own[a : a + most + overlap]
                    numbers = Numbers()
                    ids = np.array(list(map(numbers.__getitem__, part)), np.int64)
                    yield lang, list(numbers), ids, min(most, len(part))
                continue
            if size + len(own) >= most:
                yield from all_of()
                held, size = {}, 0
            size += len(own) + 1
            numbers, parts = held.setdefault(lang, (Numbers(), []))
            parts.append(np.array([*map(numbers.__getitem__, own), 0], np.int64))
    yield from all_of()


def count_words(rows: DataFrame, gather: int) -> DataFrame:
    """(lang, word, n) of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids, n in gathered(batches, 0, gather):
            count = np.bincount(ids[:n], minlength=len(words))[1:]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(count), pa.string()), pa.array(words[1:], pa.binary()), pa.array(count, pa.int64())], ["lang", "word", "n"])

    return rows.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bitmap(frequent: DataFrame) -> np.ndarray:
    """Bits at the hashes of (lang, word), a power of two of them, in words of 64."""
    size = min(BITS, max(64, 1 << (BITS_EACH * frequent.count()).bit_length()))
    at = frequent.select(F.xxhash64("lang", "word").bitwiseAND(F.lit(size - 1)).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def occurrences(ids: np.ndarray, begin: int, length: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The different stretches of up to ``length`` words of a piece, as rows of numbers (0 behind its end) in order, and
    how often each begins at one of the first ``begin`` places. Those of one word alone are left out."""
    padded = np.append(ids, np.zeros(length, np.int64))
    at = np.flatnonzero((padded[:begin] > 0) & (padded[1 : begin + 1] > 0))
    open_ = np.ones(len(at), bool)
    key, columns = np.zeros(len(at), np.int64), []
    for i in range(length):
        own = padded[at + i]
        open_ &= own > 0
        columns.append(np.where(open_, own, 0))
        if len(key) and int(key.max()) + 1 > (1 << 62) // many:
            key = np.unique(key, return_inverse=True)[1]
        key = key * many + columns[-1]
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return np.stack([c[first] for c in columns], 1), count


def project(rows: DataFrame, common: dict[tuple[str, bytes], int], frequent: np.ndarray, length: int, gather: int) -> DataFrame:
    """(lang, prefix, part, tails, ns): what follows the occurrences of a prefix in some texts, a line each, and how often."""
    sent = rows.sparkSession.sparkContext.broadcast((common, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, bits = sent.value
        for lang, words, ids, n in gathered(batches, length - 1, gather):
            seed = xxhash.xxh64_intdigest(lang.encode(), 42)
            at = np.array([xxhash.xxh64_intdigest(w, seed) & (64 * len(bits) - 1) for w in words], np.uint64)
            known = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            known[0] = False
            found, count = occurrences(np.where(known[ids], ids, 0), n, length, len(words))
            if not len(found):
                continue
            # the parts of common words, by the word behind
            parts = np.array([split.get((lang, w), 1) for w in words])
            part = np.array([crc32(w) for w in words])[found[:, 1]] % parts[found[:, 0]]
            order = np.lexsort((part, found[:, 0]))
            found, count, part = found[order], count[order], part[order]
            edges = np.append(np.flatnonzero(np.append(True, (found[1:, 0] != found[:-1, 0]) | (part[1:] != part[:-1]))), len(found))
            for a in range(0, len(edges) - 1, 10_000):
                own = edges[a : a + 10_001]
                here = slice(own[0], own[-1])
                tails = [b" ".join([words[i] for i in line if i]) for line in found[here, 1:].tolist()]
                joined = [b"\n".join(tails[x:y]) for x, y in pairwise((own - own[0]).tolist())]
                lists = pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), pa.array(count[here], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(joined), pa.string()), pa.array([words[i] for i in found[own[:-1], 0]], pa.binary()), pa.array(part[own[:-1]], pa.int32()), pa.array(joined, pa.binary()), lists],
                    ["lang", "prefix", "part", "tails", "ns"],
                )

    return rows.mapInArrow(run, "lang string, prefix binary, part int, tails binary, ns array<long>")


def grow(phrase: bytes, tails: dict[bytes, int], least: int) -> Iterator[tuple[bytes, int]]:
    """The phrases that go on from ``phrase``, found at least so often, from what follows its occurrences."""
    following: dict[bytes, dict[bytes, int]] = {}
    for tail, n in tails.items():
        word, _, rest = tail.partition(b" ")
        if word:
            own = following.setdefault(word, {})
            own[rest] = own.get(rest, 0) + n
    for word, own in following.items():
        n = sum(own.values())
        if n >= least:
            longer = phrase + b" " + word
            yield longer, n
            yield from grow(longer, own, least)


def grown(projected: DataFrame, least: int, hold: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of two words and more: one task for each prefix (or part of one),
    one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, bytes, int]] = []

        def rows() -> pa.RecordBatch:
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(made, ["lang", "phrase", "n"])

        now, tails, bar = None, {}, least
        for batch in batches:
            for lang, prefix, part, lines, ns in zip(*(batch.column(c).to_pylist() for c in ("lang", "prefix", "part", "tails", "ns")), strict=True):
                if (lang, prefix, part) != now:
                    if now:
                        out.extend((now[0], *x) for x in grow(now[1], tails, bar))
                    now, tails, bar = (lang, prefix, part), {}, least
                for tail, n in zip(lines.split(b"\n"), ns, strict=True):
                    tails[tail] = tails.get(tail, 0) + n
                if len(tails) > hold:
                    # from here on all counts of this prefix are partial
                    out.extend((lang, *x) for x in grow(now[1], tails, 1))
                    tails, bar = {}, 1
                if len(out) > 50_000:
                    yield rows()
        if now:
            out.extend((now[0], *x) for x in grow(now[1], tails, bar))
        yield rows()

    sent = projected.repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")
    counts = sent.mapInArrow(run, "lang string, phrase binary, n long")
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def phrases_of(docs: DataFrame, lang_col: str, text_col: str, longest: int, least: int, gather: int, hold: int) -> tuple[DataFrame, DataFrame]:
    """Stored (lang, word, n) of all words, and (lang, phrase, n) of the frequent phrases of two words and more."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = stored(count_words(rows, gather), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    common = words.where((F.col("n") * SHARE >= total) & (F.octet_length("word") <= LONGEST)).collect()  # at most SHARE
    parts = {(r["lang"], bytes(r["word"])): -(-r["n"] * SHARE // total) for r in common}
    frequent = bitmap(words.where(F.col("n") >= least))
    text = lambda c: F.col(c).cast("string")
    found = stored(grown(project(rows, parts, frequent, longest, gather), least, hold), "phrases")
    return words.select("lang", text("word").alias("phrase"), "n"), found.select("lang", text("phrase").alias("phrase"), "n")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    wide = [c.cast("decimal(38,0)") for c in (F.lit(1_000_000), a, a)]
    product = wide[0] * wide[1] * wide[2]
    return F.call_function("div", product.cast("decimal(38,0)"), (left.cast("decimal(38,0)") * right.cast("decimal(38,0)")).cast("decimal(38,0)"))


def best_cut(found: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): each phrase with the cut of least score, the first of equal ones."""
    known = words.unionByName(found)
    parts = F.split("phrase", " ")
    join = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = found.withColumn("words", parts).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.size("words")).alias("right"))
    side = lambda of, name: known.select("lang", F.col("phrase").alias(of), F.col("n").alias(name))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    scored = both.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    least = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return scored.groupBy("lang", "phrase", "a").agg(least.alias("x")).select("lang", "phrase", "a", "x.*")


def within_longer(found: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of those that lie within a longer phrase found at least ``percent`` of the times they are."""
    size = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda s: F.array_join(F.slice("words", s, n), " "))))
    longer = found.withColumn("words", F.split("phrase", " ")).where(size > 2)
    inner = longer.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("n").alias("outer_n")).groupBy("lang", "phrase").agg(F.max("outer_n").alias("outer_n"))
    return found.join(inner, ["lang", "phrase"]).where(100 * F.col("outer_n") >= percent * F.col("n")).select("lang", "phrase")


def best_of(rows: DataFrame, by: str, order: list[Column], key: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each value of ``by``, with their rank: in rounds over groups of about GROUP rows, each of
    which hands on its own first ones."""
    groups = -(-rows.count() // max(GROUP, 4 * most))
    while groups > 1:
        dealt = rows.withColumn("__group", F.pmod(F.xxhash64(*key), F.lit(groups)))
        rank = F.row_number().over(Window.partitionBy(by, "__group").orderBy(*order))
        rows = dealt.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank", "__group")
        groups = -(-groups * most // max(GROUP, 4 * most)) if groups > GROUP // most else 1
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, percent: int = 50, most: int = 2000, gather: int = GATHER, hold: int = HOLD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of each language, of two to ``longest`` words.

    a, l and r are the occurrences of the phrase and of its two parts, n those of all words of the language.
    """
    words, found = phrases_of(docs, lang_col, text_col, longest, least, gather, hold)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    own = best_cut(found, words.where(F.col("n") >= least)).join(within_longer(found, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    top = best_of(stored(own, "scored"), "lang", order, ["phrase"], most)
    return top.join(narrow(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(table: str, least: int, percent: int, most: int) -> str:
    """``collocations`` of two and three words in DuckDB."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""WITH pieces AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS p FROM {table}),
lists AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
ones AS (SELECT lang, unnest(w) AS phrase FROM lists),
counts AS MATERIALIZED (SELECT lang, phrase, count(*) AS f, 1 AS size FROM ones GROUP BY 1, 2
  UNION ALL SELECT lang, phrase, count(*), 2 FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM lists WHERE len(w) > 1) GROUP BY 1, 2
  UNION ALL SELECT lang, phrase, count(*), 3 FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM lists WHERE len(w) > 2) GROUP BY 1, 2),
found AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= {least}),
cuts AS MATERIALIZED (SELECT lang, phrase, f, k, array_to_string(w[1:k], ' ') AS a_part, array_to_string(w[k + 1:], ' ') AS b_part FROM (SELECT *, unnest(range(1, size)) AS k FROM found)),
scored AS (SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, 1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f) AS score FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = a_part JOIN counts y ON y.lang = c.lang AND y.phrase = b_part),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM found WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM found WHERE size = 3),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= {percent} * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY 1) t USING (lang) WHERE rank <= {most}"""
