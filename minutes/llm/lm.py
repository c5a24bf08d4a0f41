"""Language-model scores of documents: a byte model by partial matching, beside a word unigram as the base.

Both learn from the same documents. The word counts stay distributed: frequent words are broadcast within a bound,
all others are joined by shuffle (``terms``). So do the window counts of the byte model, at every order: escapes and
exclusions are worked out by joins from a context to its suffix, for the windows that the scored texts have. The
commonest of these are broadcast within a bound, all others go the way of the rare words. ``ppm`` has the same model in
one place.

Defined cases: a null text is an empty one, which has the end token and the end symbol only; a null doc_id falls in
training (it hashes as the empty text); repeated rows count and are scored row by row; with no training row every
symbol has 1/256 and every token 1/(V+1) with V = 0; a very long text is one row of its task and is scored whole; an empty
table gives no rows. Of ``docs`` only the text and the columns to keep are read, under names of their own, so other
columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ppm, terms
from .common import slices, stored, utf8

#: Context bytes of the model.
ORDER = 5
#: Windows of the broadcast head (16 bytes each).
HEAD_WINDOWS = 1_000_000
#: Windows that a task holds before it hands on their counts.
HELD_WINDOWS = 4_000_000
#: Before a window that stands as a term beside words: no byte of UTF-8.
MARK = b"\xff"
#: Bytes of text that a task works on at once.
SLICE = 1 << 20


def words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end token (the empty word)."""
    out = text.lower().split()
    out.append(b"")
    return out


def window_counts(docs: DataFrame, column: str, order: int, most: int = HELD_WINDOWS) -> DataFrame:
    """(gram, n): how often each context and symbol occurs, pre-aggregated by task."""

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, counts = ppm.add_up(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for at in range(0, len(keys), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 18)]), pa.array(counts[at : at + (1 << 18)].astype(np.int64))], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches, column, 4 * SLICE):
            held.append(ppm.count_windows([t.lower() for t in utf8(batch.column(column))], order))
            if sum(len(k) for k, _ in held) > most:
                yield from rows(held)
                held = []
        if held:
            yield from rows(held)

    return docs.select(column).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def low(gram: Column, n: int) -> Column:
    """The last ``n`` bytes of a window."""
    return gram.bitwiseAND(F.lit((1 << 8 * n) - 1))


def small(table: DataFrame, k: int) -> DataFrame:
    """Up to one context byte a table has at most 65,536 rows."""
    return F.broadcast(table) if k < 2 else table


def train(docs: DataFrame, column: str, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 0 on: (gram, n), and for each context (ctx, total, kinds) with what its suffix has besides the
    context's symbols, ``rest`` times in ``few`` kinds."""
    counts = [stored(window_counts(docs, column, order), "windows")]
    for k in range(order - 1, -1, -1):
        counts.insert(0, stored(counts[0].groupBy(low(F.col("gram"), k + 1).alias("gram")).agg(F.sum("n").alias("n")), "windows"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k, grams in enumerate(counts):
        sums = [F.sum("n").alias("total"), F.count("*").alias("kinds")]
        ctx = F.shiftright("gram", 8).alias("ctx")
        if not k:
            found = grams.groupBy(ctx).agg(*sums).withColumns({"rest": F.lit(0).cast("long"), "few": F.lit(0).cast("long")})
        else:
            shorter = counts[k - 1].select(F.col("gram").alias("part"), F.col("n").alias("m"))
            own = grams.withColumn("part", low(F.col("gram"), k)).join(small(shorter, k - 1), "part").groupBy(ctx).agg(*sums, F.sum("m").alias("m"))
            up = out[k - 1][1].select(F.col("ctx").alias("up"), F.col("total").alias("t"), F.col("kinds").alias("d"))
            found = own.withColumn("up", low(F.col("ctx"), k - 1)).join(small(up, k - 1), "up").select("ctx", "total", "kinds", (F.col("t") - F.col("m")).alias("rest"), (F.col("d") - F.col("kinds")).alias("few"))
        out.append((grams, stored(found, "contexts")))
    return out


def window_logs(asked: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, freq, log): the log10 probability of the last byte of each window of ``asked`` (gram, freq)."""
    now = asked.withColumns({"log": F.lit(0.0), "over": F.lit(None).cast("long"), "away": F.lit(None).cast("long"), "done": F.lit(False)})
    out = []
    for k in range(len(levels) - 1, -1, -1):
        grams, contexts = levels[k]
        by = now.withColumn("part", low(F.col("gram"), k + 1)).withColumn("ctx", F.shiftright("part", 8))
        met = by.join(small(grams.withColumnRenamed("gram", "part"), k), "part", "left").join(small(contexts, k - 1), "ctx", "left")
        # of the first known context all symbols count, of a shorter one those that the longer one lacks
        of = F.when(F.col("over").isNull(), F.col("total") + F.col("kinds")).otherwise(F.col("over") + F.col("away"))
        on = F.when(F.col("over").isNull(), F.col("kinds")).otherwise(F.col("away"))
        step = F.when(F.col("n").isNotNull(), F.log10(F.col("n") / of)).when(F.col("total").isNotNull() & (on > 0), F.log10(on / of)).otherwise(0.0)
        known = F.col("total").isNotNull()
        if k:
            last = F.lit(0.0)
        else:
            last = F.when(F.col("n").isNull(), -F.log10(F.greatest(F.lit(1), ppm.SYMBOLS - F.coalesce("kinds", F.lit(0))).cast("double"))).otherwise(0.0)
        now = met.select(
            "gram", "freq", (F.col("log") + step + last).alias("log"), F.when(known, F.col("rest")).otherwise(F.col("over")).alias("over"),
            F.when(known, F.col("few")).otherwise(F.col("away")).alias("away"), F.col("n").isNotNull().alias("done"),
        )
        now = stored(now, "logs")
        out.append(now.where("done") if k else now)
        now = now.where("not done")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select("gram", "freq", "log")


def window_head(logs: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """The commonest windows in order, at most HEAD_WINDOWS, with their logs, and the table of all others."""
    cell = F.floor(F.log2(F.col("freq").cast("double")) * 4).cast("int")
    least, held = 1 << 20, 0
    for at, n in sorted(((r[0], r[1]) for r in logs.groupBy(cell.alias("cell")).count().collect()), reverse=True):
        if held + n > HEAD_WINDOWS:
            break
        least, held = at, held + n
    found = logs.where(cell >= least).select("gram", "log").toArrow()
    grams, values = found.column("gram").to_numpy(), found.column("log").to_numpy()
    at = np.argsort(grams)
    # a last one that no window has
    return np.r_[grams[at], np.int64(2**63 - 1)], np.r_[values[at], 0.0], logs.where(cell < least)


def score_windows(texts: list[bytes], order: int, grams: np.ndarray, values: np.ndarray) -> tuple[list[float], list[list[tuple[bytes, int]]]]:
    """For each text the sum over windows in the head, and the others as terms with their counts."""
    run, starts = ppm.windows(texts, order)
    real = run[order:] != ppm.START
    keys, at = np.unique(ppm.codes(run, order)[real], return_inverse=True)
    text = np.repeat(np.arange(len(texts)), np.diff(np.r_[starts, len(run)]))[order:][real]
    place = np.searchsorted(grams, keys)
    known = grams[place] == keys
    sums = np.bincount(text, np.where(known, values[place], 0.0)[at], len(texts))
    rare: list[list[tuple[bytes, int]]] = [[] for _ in texts]
    out = np.flatnonzero(~known[at])
    if len(out):
        pairs, tf = np.unique(np.stack([text[out], at[out]]), axis=1, return_counts=True)
        for i, k, n in zip(*pairs.tolist(), tf.tolist(), strict=True):
            rare[i].append((MARK + int(keys[k]).to_bytes(8, "big"), n))
    return sums.tolist(), rare


def score(docs: DataFrame, training: DataFrame, order: int = ORDER, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` with n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    ``training`` holds the texts to learn from, in the same column.
    """
    spark = docs.sparkSession

    def split(column: pa.Array) -> Iterator[list[bytes]]:
        return map(words, utf8(column))

    vocabulary = stored(terms.count_terms(training, text_col, split, "binary"), "words")
    total, kinds = vocabulary.agg(F.coalesce(F.sum("freq"), F.lit(0)), F.count("*")).first()
    known = spark.sparkContext.broadcast({w: math.log10(c + 1) for w, c in terms.head(vocabulary, "freq").items()})
    asked = stored(window_counts(docs, text_col, order).withColumnRenamed("n", "freq"), "asked")
    *head, others = window_head(stored(window_logs(asked, train(training, text_col, order)), "logs"))
    model = spark.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = known.value
        for batch in slices(batches, "__text", SLICE):
            lowered = [t.lower() for t in utf8(batch.column("__text"))]
            n_tokens, n_known, sums = [], [], []
            scores, rare = score_windows(lowered, order, *model.value)
            for text, pairs in zip(lowered, rare, strict=True):
                tokens = words(text)
                found, log = 0, 0.0
                for word, tf in Counter(tokens).items():
                    c = logs.get(word)
                    if c is None:
                        pairs.append((word, tf))
                    else:
                        found += tf
                        log += tf * c
                n_tokens.append(len(tokens))
                n_known.append(found)
                sums.append(log)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    *(pa.array(x, t) for x, t in ((n_tokens, pa.int64()), (n_known, pa.int64()), (sums, pa.float64()), (scores, pa.float64()))),
                    terms.tails(rare, pa.binary()),
                ],
                names,
            )

    kept = [f"k{i}" for i in range(len(keep))]
    narrow = docs.select(F.monotonically_increasing_id().alias("uid"), *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.col(text_col).alias("__text"))
    names = ["uid", *kept, "n_tokens", "n_head", "log_head", "score", "tail"]
    schema = ", ".join(f"{c} {t}" for c, t in narrow.dtypes[:-1]) + ", n_tokens long, n_head long, log_head double, score double, tail array<struct<term binary, tf int>>"
    # a word's value is a count, from 1 on, and a window's a log, below 0
    term = F.concat(F.lit(MARK), F.unhex(F.lpad(F.hex("gram"), 16, "0")))
    values = vocabulary.select("term", F.col("freq").cast("double").alias("value")).unionByName(others.select(term.alias("term"), F.col("log").alias("value")))
    summed = terms.with_tail(
        narrow.mapInArrow(run, schema), values, "value", names[:-1],
        {
            "n_tail": lambda c, tf: F.when(c > 0, tf), "log_tail": lambda c, tf: F.when(c.isNull() | (c > 0), tf * F.log10(F.coalesce(c, F.lit(0.0)) + 1.0)),
            "score_tail": lambda c, tf: F.when(c < 0, tf * c),
        },
    )
    base = F.col("log_head") + F.coalesce("log_tail", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + kinds + 1)
    return summed.select(
        *(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("score_tail", F.lit(0.0))).alias("score"),
    )
