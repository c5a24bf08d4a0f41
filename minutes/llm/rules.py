"""Quality rules that vote: their accuracies are estimated without labels, and a posterior replaces all-must-pass.

Statistics of the whole text are worked out once and stored. On them every rule votes for a document (1), against it (-1)
or abstains (0). Most rules can only speak against a text and abstain where they find nothing, as the absence of one flaw
is no merit; the two that speak for a text ask for several ordinary measures at once. The model behind the posterior has
one number for each rule, the share of its votes that are right, whether or not a document is good; votes are taken as
independent given that, abstaining says nothing, and ``balance`` is the share of good documents taken before any vote.
Expectation-maximisation finds the accuracies from how the rules agree with each other: one that is often outvoted sinks
to even odds, where it counts nothing, and then what it alone is against is kept. All documents take part: they
are counted by their votes, and there are at most 3^rules different ones (of the twelve rules here, which have two
outcomes each, 4,096), which is what comes to the driver at any size. A document's posterior is a sum over its votes.

``base_failed`` stands beside the votes: under ten words, or over a fifth of the words in repeated five-word windows. Such
documents are never kept, whatever the posterior.

Defined cases: a null text is an empty one; a text without words has base_failed, all rules abstain on it, and its
posterior is the balance; texts of any length are measured whole; repeated rows are judged, and counted,
each; a null id is kept; an empty table gives no rows. Only the id and the text are read, under names of their own, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, utf8

#: What is measured: words, code points in words, symbols, lines with a word that repeat an earlier one, words in repeated windows;
#: then lines with a word, words with a letter, capitals and letters of a-z, exclamation marks, ends of sentences, the most frequent word.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_capitals", "n_letters", "n_shouts", "n_ends", "n_top_word")
SYMBOLS, WINDOW = b"#*$%&|<>", 5
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
#: Nothing conspicuous about a text's characters and words.
PLAIN = "n_words >= 10 AND 100 * n_symbols <= 3 * n_words AND 100 * n_shouts <= 5 * n_words AND 100 * n_capitals <= 25 * n_letters AND (n_top_word <= 3 OR 100 * n_top_word <= 15 * n_words)"
#: Rules as conditions on the measures: name, for, against. A text without words gets no vote.
RULES = [
    ("short", "false", "n_words < 10"),
    ("word_length", "false", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("symbols", "false", "100 * n_symbols > 10 * n_words"),
    ("letters", "false", "100 * n_letter_words < 80 * n_words"),
    ("capitals", "false", "n_letters >= 20 AND 100 * n_capitals > 50 * n_letters"),
    ("shouts", "false", "100 * n_shouts > 10 * n_words"),
    ("top_word", "false", "n_words >= 20 AND 100 * n_top_word > 25 * n_words"),
    ("repeats", "false", "100 * n_repeat_words > 10 * n_words"),
    ("dup_lines", "false", "10 * n_dup_lines > 3 * n_lines"),
    ("run_on", "false", "n_words >= 30 AND n_words > 150 * n_ends"),
    ("plain", f"100 * n_letter_words >= 95 * n_words AND {PLAIN}", "false"),
    ("prose", f"n_words BETWEEN 3 * n_ends AND 60 * n_ends AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND {PLAIN}", "false"),
]
MOST_RULES = 12
#: An accuracy before any document is seen; rounds at most, and the change that ends them.
START, ROUNDS, CLOSE = 0.8, 1000, 1e-9
#: Accuracies lie between even odds and this far from 1.
EDGE = 1e-4


class Numbers(dict):
    """A number for each word, in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def repeated_words(ids: np.ndarray, size: int = WINDOW) -> int:
    """Words that lie in a window found at least twice."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    key, width = ids[:n].astype(np.int64), int(ids.max()) + 1
    for i in range(1, size):
        if int(key.max()) + 1 > (1 << 62) // width:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + ids[i : i + n]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    found = np.flatnonzero(count[at] > 1)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + size, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: bytes) -> list[int]:
    words = text.split()
    n = len(words)
    if not n:
        return [0] * len(MEASURES)
    data = np.frombuffer(text, np.uint8)
    count = np.bincount(data, minlength=256)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    letter = (data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122)
    first = np.flatnonzero(~space & np.append(True, space[:-1]))
    ids = np.array(list(map(Numbers().__getitem__, words)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    of = lambda chars: int(count[np.frombuffer(chars, np.uint8)].sum())
    capitals = int(count[65:91].sum())
    return [
        n, len(text) - int(count[0x80:0xC0].sum()) - int(space.sum()), of(SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids),
        len(lines), int((np.add.reduceat(letter.astype(np.int64), first) > 0).sum()), capitals, capitals + int(count[97:123].sum()), of(b"!"), of(b".!?") + text.count("。".encode()), int(np.bincount(ids).max()),
    ]


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the measures of every text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            x = np.array([measure(t) for t in utf8(batch.column("text"))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c) for c in x.T)], ["id", *MEASURES])

    return rows.mapInArrow(run, ", ".join([f"id {dict(rows.dtypes)['id']}", *(f"{m} long" for m in MEASURES)]))


def vote(rule: tuple[str, str, str]) -> Column:
    _, good, bad = rule
    return F.when(F.col("n_words") == 0, 0).when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


def estimate(votes: np.ndarray, count: np.ndarray, balance: float) -> np.ndarray:
    """The accuracy of each rule, of rows of votes with the number of documents that have them."""
    accuracy = np.full(votes.shape[1], START)
    pro, con = (votes > 0) * count[:, None], (votes < 0) * count[:, None]
    cast = (pro + con).sum(0)
    for _ in range(ROUNDS):
        good = posterior(votes, accuracy, balance)
        right = good @ pro + (1 - good) @ con
        # a rule that never votes stays as it is
        new = np.where(cast > 0, np.clip(right / np.maximum(cast, 1), 0.5, 1 - EDGE), accuracy)
        if np.abs(new - accuracy).max() < CLOSE:
            break
        accuracy = new
    return accuracy


def log_odds(x):
    return np.log(x / (1 - x))


def posterior(votes: np.ndarray, accuracy: np.ndarray, balance: float) -> np.ndarray:
    return 1 / (1 + np.exp(-(log_odds(balance) + votes @ log_odds(accuracy))))


def pattern(rules: list[tuple[str, str, str]]) -> Column:
    """All votes as one number in base 3."""
    return reduce(add, ((F.col(f"vote_{i}") + 1) * 3**i for i in range(len(rules))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple[str, str, str]] | None = None, base_failed: str = BASE_FAILED, balance: float = 0.5, least: float = 0.5) -> DataFrame:
    """(id, measures, base_failed, p_good, votes_for, votes_against, kept) of every document; kept from a posterior of ``least``, give or
    take the rounding of a sum."""
    rules = RULES if rules is None else rules
    if not 0 < len(rules) <= MOST_RULES:
        raise ValueError(f"1 to {MOST_RULES} rules")
    seen = stored(measured(docs, id_col, text_col), "measures").withColumns({f"vote_{i}": vote(r) for i, r in enumerate(rules)})
    counted = sorted((r["p"], r["n"]) for r in seen.groupBy(pattern(rules).alias("p")).agg(F.count("*").alias("n")).collect())
    votes = np.array([[p // 3**i % 3 - 1 for i in range(len(rules))] for p, _ in counted]).reshape(-1, len(rules))
    accuracy = estimate(votes, np.array([n for _, n in counted], float), balance)
    odds = F.lit(float(log_odds(balance)))
    for i in range(len(rules)):
        odds = odds + F.col(f"vote_{i}") * float(log_odds(accuracy[i]))
    names = lambda sign: F.array_join(F.array_compact(F.array(*(F.when(F.col(f"vote_{i}") == sign, r[0]) for i, r in enumerate(rules)))), ",")
    out = seen.withColumns({"base_failed": F.expr(base_failed), "p_good": 1 / (1 + F.exp(-odds)), "votes_for": names(1), "votes_against": names(-1)})
    return out.select(F.col("id").alias(id_col), *MEASURES, "base_failed", "p_good", "votes_for", "votes_against", (~F.col("base_failed") & (F.col("p_good") > least - 1e-9)).alias("kept"))
