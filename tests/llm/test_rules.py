"""Quality rules against plain counting and expectation-maximisation document by document."""

import math
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import DATA  # noqa: E402

from minutes.llm import queries, rules  # noqa: E402


def counted(text):
    """The measures of the contract, plainly."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


TEXTS = {
    1: "Ein Satz, der steht. Und noch einer, der geht!\nUnd drei.", 2: None, 3: "", 4: " \t\n\x0b ", 5: "a b c d e a b c d e", 6: "a a a a a a a", 7: "x" * 5000, 8: "é ü ß　世界 ok\n" * 3,
    9: "# * $ % & | < >\n# * $ % & | < >", 10: "one two three four five six seven eight nine ten " * 2, 11: "A\r\nA\n\nA\n A", 12: "w " * 30_000, 13: "\x00 \x1c \x85 a b", 14: " ".join(str(i % 7001) for i in range(20_000)),
}


def test_measures(spark):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in TEXTS.items()] + [(None, TEXTS[1], 1, "k"), (1, TEXTS[1], 1, "k")], "doc_id long, text string, n_words int, kept string")
    got = rules.judge(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = counted(TEXTS[1 if r.doc_id is None else r.doc_id])
        assert tuple(r[m] for m in rules.MEASURES[:5]) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept) and 0 <= r.p_good <= 1
    assert rules.judge(docs.limit(0)).collect() == []


def test_repeated_words_when_keys_do_not_fit():
    rng = np.random.default_rng(2)
    ids = np.concatenate([np.arange(9000), rng.permutation(9000), np.arange(100, 150), rng.integers(0, 3, 500)])
    seen = {}
    for i in range(len(ids) - 4):
        seen.setdefault(tuple(ids[i : i + 5].tolist()), []).append(i)
    assert rules.repeated_words(ids) == len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)})


def plain_em(votes, balance):
    """Document by document, without numpy."""
    a = [rules.START] * len(votes[0])
    post = lambda v: 1 / (1 + math.exp(-(math.log(balance / (1 - balance)) + sum(x * math.log(p / (1 - p)) for x, p in zip(v, a, strict=True)))))
    for _ in range(rules.ROUNDS):
        p = [post(v) for v in votes]
        own = [[(q if v[j] > 0 else 1 - q) for v, q in zip(votes, p, strict=True) if v[j]] for j in range(len(a))]
        new = [min(max(sum(x) / len(x), 0.5), 1 - rules.EDGE) if x else a[j] for j, x in enumerate(own)]
        if max(abs(x - y) for x, y in zip(new, a, strict=True)) < rules.CLOSE:
            break
        a = new
    return [post(v) for v in votes]


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_op12(spark):
    """The whole result: plain counts, and the posterior of each document worked out one by one."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r.doc_id: r for r in queries.op12_quality_rules(spark, str(DATA)).collect()}
    assert set(rows) == set(docs)
    names = [r[0] for r in rules.RULES]
    whole = {r.doc_id: r for r in rules.judge(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    votes = [[(n in whole[i].votes_for.split(",")) - (n in whole[i].votes_against.split(",")) for n in names] for i in docs]
    for (i, text), p in zip(docs.items(), plain_em(votes, 0.5), strict=True):
        r, want = rows[i], counted(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert abs(r.p_good - p) < 1e-5 and r.kept == (not r.base_failed and p > 0.5 - 1e-9)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_verdicts_agree_with_labels_not_seen(spark):
    data = str(DATA.parent / "sf0.01")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [(r, label[r.doc_id]) for r in queries.op12_quality_rules(spark, data).collect() if r.doc_id in label and not r.base_failed]
    assert all(r.kept for r, q in rows if q == 1) and sum(not r.kept for r, q in rows if q == 0) >= 0.9 * sum(q == 0 for _, q in rows)


def test_an_outvoted_rule_loses_its_say(spark):
    """A rule that is against what two others are for sinks to even odds; one that agrees with others keeps its say."""
    votes = np.array([[1, 1, -1, 0], [1, 1, 0, 0], [0, 0, -1, 0], [0, -1, 0, -1], [0, 0, 0, -1], [0, 0, 0, 0]])
    a = rules.estimate(votes, np.array([300.0, 500, 5, 100, 40, 10]), 0.5)
    p = rules.posterior(votes, a, 0.5)
    assert a[2] == 0.5 and a[3] > 0.8 and p[0] > 0.9 and p[2] > 0.49 and p[3] < 0.1 and p[4] < 0.5 and p[5] == 0.5
    # the rules are parameters
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "")], "doc_id long, text string")
    own = rules.judge(docs, rules=[("three", "n_words = 3", "n_words < 3")], base_failed="false")
    assert {r.doc_id: (r.kept, r.votes_for, r.votes_against) for r in own.collect()} == {1: (True, "three", ""), 2: (False, "", "three"), 3: (True, "", "")}
    with pytest.raises(ValueError):
        rules.judge(docs, rules=[])
