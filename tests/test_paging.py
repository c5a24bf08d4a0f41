"""Pages of a written ranking against the offset form."""

import random

import pytest

from minutes.operators import paging, search


@pytest.mark.parametrize("by", ["date", "relevance"])
def test_pages_equal_offsets(spark, tmp_path, by):
    rng = random.Random(1)
    rows = [(i, None if rng.random() < 0.1 else f"2025-01-{rng.randint(1, 9):02d}", rng.randint(0, 5)) for i in range(530)]
    found = spark.createDataFrame(rows, "ord long, date string, score int").repartition(5)
    path = str(tmp_path / "ranking")
    paging.write_ranking(found, path, by, rows=60)
    assert len(paging.ranges_of(spark, path)) > 5
    ranked = search.rank(found, by)
    for n in (1, 2, 14, 27, 28):
        want = [r.ord for r in search.page(ranked, n).collect()]
        got = paging.read_page(spark, path, n).collect()
        assert [r.ord for r in got] == want and [r["rank"] for r in got] == list(range(20 * n - 19, 20 * n - 19 + len(want)))
    plan = paging.read_page(spark, path, 14)._jdf.queryExecution().executedPlan().toString()
    assert "chunk" in plan.split("PartitionFilters")[1].split("]")[0]
    here = {c for c, before, rows in paging.ranges_of(spark, path) if before < 280 and before + rows > 260}
    assert 1 <= len(here) <= 2


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    paging.write_ranking(spark.createDataFrame([], "ord long, date string, score int"), path)
    assert paging.read_page(spark, path).collect() == [] and paging.read_page(spark, path, 7).collect() == []
