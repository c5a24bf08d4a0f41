"""The registered queries over whole tables: against SQL where there is one, else against brute force."""

import collections
import math
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import DATA, same  # noqa: E402

from minutes.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name])


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op3(spark, docs):
    from minutes.llm import tokens

    model = tokens.load(queries.tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op3_token_counts(spark, str(DATA)).collect()}
    assert got == {i: (len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in docs.items()}


def test_op4(spark, docs):
    rows = queries.op4_pii(spark, str(DATA)).collect()
    private = re.compile(r"[\w.]+@[\w.]+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])|(?<!\d)\d{16}(?!\d)|AKIA\w{16}")
    assert len(rows) == len(docs)
    # a number without a right check digit is no card and stays
    card = lambda x: not x.isdigit() or sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(x[::-1])) % 10 == 0
    for r in rows:
        old = docs[r.doc_id]
        assert not set(filter(card, private.findall(old))) & set(private.findall(r.text)) and len(private.findall(old)) == len(private.findall(r.text))
        assert (r.text == old) == (r.n_replaced == 0)


def test_op5(spark, docs):
    def fingerprint(text):
        words = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fingerprint(t) for i, t in docs.items()}
    group = {i: i for i in sorted(docs)}
    for a in group:
        for b in group:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, str(DATA)).collect()}
    assert got == {i: (f"{prints[i]:016x}", group[i]) for i in docs}


def test_op9(spark):
    # sf0.001 holds out 19 labels (17 of them come out right), too few for a share
    data = str(DATA.parent / "sf0.01")
    ids = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
    rows = {r.doc_id: r for r in queries.op9_quality(spark, data).collect()}
    assert set(rows) == ids and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (crc(i, 5) == 0) for i, r in rows.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [i for i in labels if i in rows and rows[i].held_out]
    assert sum(rows[i].predicted == labels[i] for i in held) >= 0.9 * len(held)
    # the whole result by plain least squares and the min-max form of isotonic regression
    from minutes.llm import quality

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    x = {i: np.array(quality.statistics(t.encode())) for i, t in texts.items()}
    train = [i for i in texts if i in labels and crc(i, 5) != 0]
    held = np.array([zlib.crc32(f"calibrate{i}".encode()) % 5 == 0 for i in train])
    y, own = np.array([labels[i] for i in train], float), np.array([x[i] for i in train])
    mean, scale = own.mean(0), np.maximum(own.std(0), 1e-6)
    z = quality.lift((own - mean) / scale)
    fit, n = z[~held], z.shape[1] - 1
    ridge = np.diag([quality.RIDGE * len(fit) / n] * n + [0.0]) + 1e-9 * np.eye(n + 1)
    weights = np.linalg.solve(fit.T @ fit + ridge, fit.T @ y[~held])
    cell = np.floor((np.clip(z[held] @ weights, -1, 2) + 1) / 3 * quality.CELLS).astype(int)
    at = np.unique(cell)
    ones, of = np.array([y[held][cell == c].sum() for c in at]), np.array([(cell == c).sum() for c in at])
    share = lambda a, b: ones[a : b + 1].sum() / of[a : b + 1].sum()
    risen = [max(min(share(a, b) for b in range(k, len(at))) for a in range(k + 1)) for k in range(len(at))]
    raw = quality.lift((np.array([x[i] for i in texts]) - mean) / scale) @ weights
    want = np.interp(raw, (at + 0.5) / quality.CELLS * 3 - 1, risen)
    got = np.array([rows[i].score for i in texts])
    # a score next to the edge of a cell may fall to either side of it
    assert (np.abs(got - want) < 1e-6).mean() > 0.98 and np.abs(got - want).max() < 0.1


def test_op10(spark, docs):
    words = lambda t: [*t.encode().lower().split(), b""]
    c = collections.Counter(w for i, t in docs.items() if crc(i, 7) != 2 for w in words(t))
    n, v = sum(c.values()), len(c)
    rows = queries.op10_lm_scores(spark, str(DATA)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = words(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id, 7) == 2, len(own), sum(c[w] > 0 for w in own), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
    # every score against the model in one place, which itself is held against plain dictionaries
    from minutes.llm import lm, ppm

    model = ppm.Model(*ppm.count_windows([t.encode().lower() for i, t in docs.items() if crc(i, 7) != 2], lm.ORDER), lm.ORDER)
    want = dict(zip(docs, model.score([t.encode().lower() for t in docs.values()]), strict=True))
    assert all(abs(r.score - want[r.doc_id]) < 1e-3 + 1e-5 * abs(want[r.doc_id]) for r in rows)


def test_pipeline(spark, docs):
    import corpus_pipeline

    from minutes.llm.common import stored, table

    now, columns = table(spark, str(DATA), "documents"), None
    sizes = [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        columns = now.columns
        now = stored(stage(spark, now, str(DATA)), name)
        sizes.append(now.count())
        assert now.columns[: len(columns)] == columns
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] and 0 < sizes[5] <= 1.5 * sizes[4]
    assert "mix_epoch" in now.columns
