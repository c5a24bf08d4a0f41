"""Every stage of the corpus pipeline on nulls, empty, long and repeated texts, clashing columns and empty tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

LONG = "a very long text of ordinary words, line after line.\n" * 20_000
ITEM = "one two three four five six seven eight nine ten eleven twelve"
GOOD = [f"The {w} house stood by the river, and people walked past it every morning on their way to the {w} market." for w in ("old", "new", "red", "tall", "quiet", "small", "busy", "empty")]
JUNK = [f"$$$ {w}!!! ||| CLICK {w} ### &&& !!! {w} <> [] {w}" for w in ("BUY", "NOW", "WIN", "FREE")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("stages"))
    n = range(400)
    rows = [(i, GOOD[i % 8] + f" It was number {i} {i * 7} of {i * 13}." if i % 3 else JUNK[i % 4] * (1 + i % 5), "en", "big" if i % 3 else f"s{i % 4}") for i in n]
    rows += [(1000, GOOD[0] + " " + ITEM, "en", None), (1001, LONG, "en", "big"), (1002, LONG, "en", "big"), (1003, "", "en", "s1"), (1004, None, "en", "s1"), (None, "mail bob@example.com", "en", "s1"), (None, None, None, None), (4, rows[4][1], "en", "big")]
    extra = ", ".join(f"{c} string" for c in ("uid", "hash", "node", "label", "x", "fp", "size", "n"))
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *["clash"] * 8) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in n] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_in_turn(spark, folder):
    from minutes.llm.common import scratch_scope, stored

    with scratch_scope(spark):
        now = spark.read.parquet(f"{folder}/documents.parquet")
        names, ids = now.columns, {}
        for name, stage in corpus_pipeline.STAGES:
            now = stored(stage(spark, now, folder), name)
            assert now.columns[: len(names)] == names
            ids[name] = [r.doc_id for r in now.select("doc_id").collect()]
            texts = {r.doc_id: r.text for r in now.collect()}
        assert set(now.columns[len(names) :]) == {"mix_weight", "mix_epoch", "mix_block", "mix_slot"} and now.where("uid <> 'clash'").count() == 0
    good = {i for i in range(400) if i % 3}
    assert good <= set(ids["quality"]) and not [i for i in ids["quality"] if i is not None and i < 400 and i % 3 == 0]
    assert ids["near_duplicates"].count(4) == 1 and 1002 not in ids["near_duplicates"] and 1001 in ids["near_duplicates"]
    assert 1000 not in ids["decontamination"] and set(ids["near_duplicates"]) - set(ids["decontamination"]) == {1000}
    assert "bob@" not in (texts.get(None) or "")


def test_stages_of_no_rows(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, none, folder)
        assert found.count() == 0 and found.columns[: len(none.columns)] == none.columns
