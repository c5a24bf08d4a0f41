"""Hold registered queries against their SQL in DuckDB over the driver's smallest tables."""

from pathlib import Path

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 6)
    return value


def same(spark, query, sql):
    """The rows of a query and of its SQL, columns in order of name."""
    import duckdb

    base = duckdb.connect()
    for t in TABLES:
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = query(spark, str(DATA))
    relation = base.sql(sql)
    assert sorted(found.columns) == sorted(relation.columns)
    order = sorted(relation.columns)
    places = [relation.columns.index(c) for c in order]
    got = sorted(repr([plain(r[c]) for c in order]) for r in found.collect())
    want = sorted(repr([plain(r[i]) for i in places]) for r in relation.fetchall())
    assert got == want
