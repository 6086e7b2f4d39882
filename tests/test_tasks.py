"""Queries of tasks on small tables of their own."""

from capsight.plans import tasks


def test_customers_of_any_order_are_answered(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "P"), (2, "O")], "o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.c_custkey for r in tasks.distinct_unanswered(spark, str(tmp_path)).collect()] == [3]
