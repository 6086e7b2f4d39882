"""Queries of decisions on odd rows."""

import duckdb

from capsight.plans import decisions


def test_bounded_numbers_of_null_and_negative_ids(spark, tmp_path):
    rows = [(None, '{"k": 3}'), (-1, '{"k": 4}'), (-7, '{"k": 5}'), (-8, '{"k": 6}'), (7, None), (15, '{"k": 0}'), (6, None), (3, None)]
    spark.createDataFrame(rows, "event_id long, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = con.execute(decisions.ORACLE_SQL["bounded_numbers"]).fetchall()
    found = [tuple(r) for r in decisions.bounded_numbers(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
