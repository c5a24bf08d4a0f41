"""Quality classifier: a Gaussian-kernel ridge score of document statistics, calibrated by isotonic regression.

Statistics of the whole text go through random Fourier features, cos(Wx + b) with Gaussian W, whose inner products
approximate a Gaussian kernel. Each task sums the normal equations of its rows; the sums are added up by matrix row
and solved. Held-back training rows then give a monotone map from score to probability (pooled adjacent violators over
a fixed grid of scores). Ids, languages, sources and labels are never features.

The model learns from at most ``max_rows`` labelled documents (chosen by a hash of the id, so the same at any size of
cluster); scores are computed for every document.

Defined cases: a null text is scored as an empty one; null labels and null ids do not train; repeated rows are scored
each; a document with several labels trains with the least of them; if the held-back rows lack a class, all training
rows calibrate; without a training row of either class the score
is the share of ones seen, or one half; a very long text is one row of its task and is scored whole; an empty table
gives no rows. ``score`` reads the id and the text column only, under names of its own, so other columns may have any
name; ``keep_good`` gives back the columns of its input, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, utf8

MAX_ROWS = 200_000
FEATURES, WIDTH, RIDGE, SEED = 384, 1.6, 1e-3, 7
#: Cells of the score grid for calibration, from -1 to 2.
CELLS = 1500
_PUNCTUATION = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
STATISTICS = (
    "length", "upper", "digit", "punctuation", "beyond_ascii", "exclaim", "pipe", "symbol", "comma_stop", "distinct", "top_word",
    "repeat_next", "word_mean", "word_spread", "lines", "distinct_lines", "line_spread", "capital_words", "longest_word", "brackets",
)


def statistics(text: bytes) -> list[float]:
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_sizes = np.fromiter(map(len, lines), np.float64, len(lines))
    same = sum(map(bytes.__eq__, words, words[1:]))
    upper = int(count[65:91].sum())
    of = lambda chars: int(count[np.frombuffer(chars, np.uint8)].sum())
    return [
        np.log1p(size) / 8, upper / size, int(count[48:58].sum()) / size * 4, int(count[_PUNCTUATION].sum()) / size * 4, int(count[128:].sum()) / size * 2,
        min(1.0, of(b"!") / n), min(1.0, of(b"|") / n), min(1.0, of(b"#$%&*") / n), min(1.0, of(b",.;:") / n * 2), len(seen) / n, max(seen.values()) / n * 2,
        same / n, min(2.0, lengths.mean() / 8), min(2.0, lengths.std() / 5), min(1.0, len(lines) / n * 4), len(set(lines)) / len(lines),
        min(2.0, line_sizes.std() / (line_sizes.mean() + 1)), min(1.0, upper / n / 2), min(2.0, np.log1p(lengths.max()) / 4), min(1.0, of(b"<>{}[]") / n),
    ]


def features(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` without its text, with the statistics of it as array x."""
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 4 << 20):
            x = [statistics(t) for t in utf8(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(x, pa.list_(pa.float64()))], [*rest, "x"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "x array<double>"]))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the random features, then the constant
    knots: np.ndarray  # scores, rising
    values: np.ndarray  # probabilities there

    def raw(self, x: np.ndarray) -> np.ndarray:
        return lift((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def lift(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((x.shape[1], FEATURES)) / (WIDTH * np.sqrt(x.shape[1]))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.cos(x @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(len(x), -1)


def pooled(scores: np.ndarray, ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Isotonic regression: rising means of 0/1 outcomes, by pooling neighbours that fall."""
    stack: list[list[float]] = []
    for s, k in zip(ones, n, strict=True):
        stack.append([s, k, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            s2, k2, w2 = stack.pop()
            stack[-1] = [stack[-1][0] + s2, stack[-1][1] + k2, stack[-1][2] + w2]
    return np.concatenate([np.full(w, s / k) for s, k, w in stack]) if stack else np.zeros(0)


def fit(rows: DataFrame) -> Model:
    """A model from (x, label, calibrate): the normal equations of some rows, the calibration of the others."""
    size = len(STATISTICS)
    moments = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), *(f(F.col("x")[i]) for i in range(size) for f in (F.avg, F.stddev_pop))).first()
    total, ones = moments[0], moments[1]
    if not 0 < ones < total:
        share = ones / total if total else 0.5
        return Model(np.zeros(size), np.ones(size), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([share, share]))
    mean, scale = np.array(moments[2::2], float), np.maximum(np.array(moments[3::2], float), 1e-6)
    width = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((width, width + 1))
        for batch in batches:
            if batch.num_rows:
                z = lift((matrix(batch) - mean) / scale)
                held += z.T @ np.hstack([z, batch.column("label").to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([r.tobytes() for r in held], pa.binary())], ["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v").to_pylist(), strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["i", "v"])

    parts = rows.where("not calibrate").select("x", F.col("label").cast("double").alias("label")).mapInArrow(sums, "i int, v binary")
    whole = {r["i"]: np.frombuffer(bytes(r["v"])) for r in parts.repartition(16, "i").mapInArrow(add, "i int, v binary").collect()}
    equations = np.stack([whole[i] for i in range(width)])
    gram, right = equations[:, :width], equations[:, width]
    ridge = RIDGE * gram[-1, -1] / FEATURES * np.eye(width)
    ridge[-1, -1] = 0
    model = Model(mean, scale, np.linalg.solve(gram + ridge + 1e-9 * np.eye(width), right), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.floor((np.clip(model.raw(matrix(batch)), -1, 2) + 1) / 3 * CELLS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("label")], ["cell", "label"])

    def grid(part: DataFrame) -> list[tuple]:
        found = part.select("x", F.col("label").cast("int").alias("label")).mapInArrow(scored, "cell int, label int")
        return sorted(tuple(r) for r in found.groupBy("cell").agg(F.sum("label"), F.count("*")).collect())

    cells = grid(rows.where("calibrate"))
    if not 0 < sum(c[1] for c in cells) < sum(c[2] for c in cells):
        cells = grid(rows)
    at, good, n = (np.array(c, float) for c in zip(*cells, strict=True))
    model.knots, model.values = (at + 0.5) / CELLS * 3 - 1, pooled(at, good, n)
    return model


def chosen(labels: DataFrame, train: Column, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(doc_id, label, calibrate) of about ``max_rows`` documents to learn from at most."""
    labelled = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(train).dropna()
    labelled = labelled.groupBy("doc_id").agg(F.min("label").alias("label"))
    share = min(1.0, max_rows / max(1, labelled.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = labelled.where(place < int(share * (1 << 30))) if share < 1 else labelled
    calibrate = F.pmod(F.crc32(F.concat(F.lit("calibrate"), F.col("doc_id").cast("string")).cast("binary")), F.lit(5)) == 0
    return stored(some.select("doc_id", "label", calibrate.alias("calibrate")), "chosen")


def score(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, score, predicted) for every row; labels are learned where ``train``, an expression of ``doc_id``, holds."""
    own = stored(features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text"), "statistics")
    # a bounded number of narrow rows
    rows = own.join(F.broadcast(chosen(labels, train, id_col, label_col, max_rows)), "doc_id")
    model = docs.sparkSession.sparkContext.broadcast(fit(stored(rows.select("x", "label", "calibrate"), "training")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(model.value.score(matrix(batch)), 0, 1))], ["doc_id", "score"])

    found = own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, score double")
    return found.select(F.col("doc_id").alias(id_col), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts. Statistics are worked out of the texts to learn from, then of each
    text where it is judged; no text is shuffled."""
    some = F.broadcast(chosen(labels, train, id_col, label_col, max_rows))
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(some, "doc_id")
    model = docs.sparkSession.sparkContext.broadcast(fit(stored(features(known, "text").select("x", "label", "calibrate"), "training")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 4 << 20):
            x = np.array([statistics(t) for t in utf8(batch.column(text_col))])
            yield batch.filter(pa.array(model.value.score(x) >= cut))

    return docs.mapInArrow(run, docs.schema)
