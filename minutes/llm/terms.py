"""Term dictionaries: count terms over a corpus, and join a per-term value back to documents.

Terms follow a power law, so a join of documents with a term table has hot keys and mostly repeats the
same few rows. The join is therefore split by frequency, without loss: the most frequent terms (a number
and size bounded by parameters) are broadcast and summed where the document is read; every other term goes
through an ordinary shuffle join and is summed by document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of the broadcast head, and the longest of them (in bytes): 200,000 x 64 B bounds it by 13 MB.
HEAD_TERMS = 200_000
HEAD_BYTES = 64
#: Longer terms of the head, up to LONG_BYTES each: as many of the commonest as this bounds.
LONG_TERMS, LONG_BYTES = 500, 1 << 14
#: Distinct terms a task gathers before it hands them on.
FLUSH = 250_000


def count_terms(docs: DataFrame, column: str, split: Callable[[pa.Array], Iterator[list]], kind: str) -> DataFrame:
    """(term, freq): occurrences of every term, pre-aggregated in the task that reads the text.

    ``split`` gives the list of terms of each value of an Arrow column; ``kind`` is string or binary.
    """
    arrow = pa.string() if kind == "string" else pa.binary()

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held.keys()), arrow), pa.array(list(held.values()), pa.int64())], ["term", "freq"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for terms in split(batch.column(0)):
                held.update(terms)
                if len(held) >= FLUSH:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    return docs.select(column).mapInArrow(run, f"term {kind}, freq long").groupBy("term").agg(F.sum("freq").alias("freq"))


def commonest(vocabulary: DataFrame, value: str, most: int) -> dict:
    """The values of the most frequent terms, at most ``most``.

    The frequency limit comes from a histogram of frequencies (64 x 4 bins), so no sort of the vocabulary.
    """
    cell = F.floor(F.log2(F.col("freq").cast("double")) * 4).cast("int")
    bins = sorted(((r[0], r[1]) for r in vocabulary.groupBy(cell.alias("cell")).count().collect()), reverse=True)
    least, held = None, 0
    for at, n in bins:
        if held + n > most:
            break
        least, held = at, held + n
    if least is None:
        return {}
    found = vocabulary.where(cell >= least).select("term", value).toArrow()
    keys = found.column("term").to_pylist()
    return dict(zip((bytes(k) if isinstance(k, bytearray) else k for k in keys), found.column(value).to_pylist(), strict=True))


def head(vocabulary: DataFrame, value: str) -> dict:
    """The values of the most frequent terms: at most HEAD_TERMS of at most HEAD_BYTES bytes, and LONG_TERMS longer ones of
    at most LONG_BYTES. A term that is longer still is a row of its own size wherever it stands, and is shuffled."""
    size = F.octet_length("term")
    short = commonest(vocabulary.where(size <= HEAD_BYTES), value, HEAD_TERMS)
    return short | commonest(vocabulary.where((size > HEAD_BYTES) & (size <= LONG_BYTES)), value, LONG_TERMS)


def tails(counted: list[list[tuple]], arrow: pa.DataType) -> pa.Array:
    """A list column of (term, tf) for each document."""
    offsets, terms, tfs = [0], [], []
    for pairs in counted:
        terms.extend(t for t, _ in pairs)
        tfs.extend(n for _, n in pairs)
        offsets.append(len(terms))
    pair = pa.StructArray.from_arrays([pa.array(terms, arrow), pa.array(tfs, pa.int32())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pair)


def with_tail(docs: DataFrame, vocabulary: DataFrame, value: str, key: list[str], sums: dict) -> DataFrame:
    """Join the rare terms in ``docs.tail`` to ``vocabulary`` and sum by document.

    sums: output column -> function of (value or null, tf). A document without rare terms gets a key of its own
    number instead of null, so that such rows spread over the join's partitions; it adds nothing.
    """
    kind = dict(vocabulary.dtypes)["term"]
    flat = docs.select(*key, F.explode_outer("tail").alias("t")).select(
        *key, F.col("t.term").isNotNull().alias("real"), F.coalesce(F.col("t.term"), F.col("uid").cast("string").cast(kind)).alias("term"), F.col("t.tf").alias("tf")
    )
    joined = flat.join(vocabulary.select("term", F.col(value).alias("value")), "term", "left")
    return joined.groupBy(*key).agg(
        *(F.sum(F.when(F.col("real"), f(F.col("value"), F.col("tf")))).alias(name) for name, f in sums.items())
    )
