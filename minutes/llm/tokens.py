"""Token counts without token ids: pieces are counted once per distinct pre-token.

A pre-token is a run of spaces with the word after it, or a newline with the word after it. No piece of the
vocabulary has a space mark behind another character or a newline, so no merge crosses a pre-token's edge and
a text's count is the sum of its pre-tokens' counts (``check_vocabulary`` verifies this for the given file).

Defined cases: a null or empty text has no tokens; repeated documents are counted row by row; a null doc_id is
kept; a text of any length is counted whole; an empty table gives an empty result. Only the id and the text column are
read, under names of their own, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import terms
from .common import stored, texts

#: How the library writes a space inside pieces.
MARK = "▁"
_PARTS = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without the first space mark (a leading newline stays)."""
    if not text:
        return []
    spaced = text.replace("\n", " \n")
    if spaced[0] == " " or spaced[-1] == " " or "  " in spaced or MARK in spaced:
        parts = _PARTS.findall(MARK + text.replace(" ", MARK))
        return [p[1:] if p[0] == MARK else p for p in parts]
    return spaced.split(" ")


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_vocabulary(path: str) -> None:
    model = load(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if bad := [p for p in pieces if MARK in p.lstrip(MARK) or "\n" in p]:
        raise ValueError(f"pieces cross pre-tokens: {bad[:5]}")


def piece_counts(model, words: list[str]) -> list[int]:
    """Pieces of each pre-token. The library puts a space mark in front of a text: that is the mark cut off by
    ``pretokens``, or one piece too many before a newline."""
    found = model.encode(words, num_threads=1)
    return [1 if not w else len(ids) - (w[0] == "\n") for w, ids in zip(words, found, strict=True)]


def vocabulary(docs: DataFrame, column: str, path: str) -> DataFrame:
    """(term, freq, pieces) for every distinct pre-token of the corpus; one encoding for each."""

    def split(column: pa.Array) -> Iterator[list[str]]:
        return map(pretokens, texts(column))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            n = piece_counts(model, batch.column("term").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], ["term", "freq", "pieces"])

    return terms.count_terms(docs, column, split, "string").mapInArrow(count, "term string, freq long, pieces long")


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    spark = docs.sparkSession
    check_vocabulary(path)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = stored(vocabulary(narrow, "text", path), "pieces")
    known = spark.sparkContext.broadcast(terms.head(words, "pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = known.value
        for batch in batches:
            sums, rare = [], []
            for text in texts(batch.column("text")):
                total, pairs = 0, []
                for word, tf in Counter(pretokens(text)).items():
                    n = pieces.get(word)
                    if n is None:
                        pairs.append((word, tf))
                    else:
                        total += n * tf
                sums.append(total)
                rare.append(pairs)
            size = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("doc_id"), size, pa.array(sums, pa.int64()), terms.tails(rare, pa.string())],
                ["uid", "doc_id", "n_bytes", "n_head", "tail"],
            )

    kind = dict(narrow.dtypes)["doc_id"]
    counted = narrow.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(
        run, f"uid long, doc_id {kind}, n_bytes long, n_head long, tail array<struct<term string, tf int>>"
    )
    summed = terms.with_tail(counted, words, "pieces", ["uid", "doc_id", "n_bytes", "n_head"], {"n_tail": lambda n, tf: n * tf})
    total = F.col("n_head") + F.coalesce(F.col("n_tail"), F.lit(0))
    return summed.select(F.col("doc_id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
