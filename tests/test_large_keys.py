"""Queries whose names come from keys, on keys of more digits than are shown."""

import duckdb

from minutes import queries
from minutes.operators import speeches


def same(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{table}.parquet"))
    base = duckdb.connect()
    base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = queries.queries()[name](spark, str(folder))
    want = base.sql(f"SELECT {', '.join(found.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert len(want) == len(rows) and sorted(map(tuple, found.collect())) == sorted(want)


def test_seat_resolution(spark, tmp_path):
    keys = [*range(123_450, 123_460), 12_345, 1, 59_999_999]
    same(spark, tmp_path, "seat_resolution", "customer", [(k, 7) for k in keys], "c_custkey long, c_nationkey int")


def test_a_roster_of_many(spark):
    """Quadratic work over so many names would take hours."""
    roster = "出席議員（名） " + " ".join(f"{i}番 {chr(0x4E00 + i % 1000)}{chr(0x4E00 + i // 1000)}" for i in range(60_000)) + " 1番 一一 欠席議員"
    seats = speeches.seat_rows(spark.createDataFrame([("a", roster)], "text_key string, raw string"))
    said = spark.createDataFrame([("a", "一一", "番"), ("a", "七丂", "9番"), ("a", "七丂", "町長"), ("a", "不明", "番"), ("b", "一一", "番")], "text_key string, name string, role string")
    assert seats.count() == 60_000
    assert sorted(r.role for r in speeches.with_seats(said, seats).collect()) == ["1番", "2003番", "町長", "番", "番"]


def test_questioners(spark, tmp_path):
    keys = [*range(12_340, 12_350), 1234, 7, 99_999_999]
    same(spark, tmp_path, "questioners", "supplier", [(k, 3) for k in keys], "s_suppkey long, s_nationkey int")
