"""Values at ranks, without all values of a key in one task."""

import random

from pyspark.sql import functions as F

from capsight.operators import protocols, series


def test_values_at_ranks(spark, ):
    rng = random.Random(3)
    values = [("a", rng.choice([None, -1.5, 0.0, 7.0, rng.random()])) for _ in range(400)] + [(None, float(k % 7)) for k in range(20)] + [("one", 4.0), ("none", None), ("equal", 2.0)] * 3
    rows = spark.createDataFrame(values, "k string, v double").repartition(5)
    # every value a range of its own
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = series.ranked(rows, "k", "v", low=F.expr("(n + 1) div 2"), high=F.expr("n div 2 + 1"), p95=series.rank_of(95), beyond=F.col("n") + 1).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    of = {}
    for k, v in values:
        of.setdefault(k, []).extend([] if v is None else [v])
    at = lambda some, rank: sorted(some)[rank - 1] if some else None
    expected = {k: (at(v, (len(v) + 1) // 2), at(v, len(v) // 2 + 1 if v else 0), at(v, -(-len(v) * 95 // 100)), None) for k, v in of.items()}
    assert {r.k: (r.low, r.high, r.p95, r.beyond) for r in found} == expected


def test_latency_of_groups_with_null_and_of_all_rows(spark):
    rows = spark.createDataFrame([(None, 1, 5.0), (None, 1, 9.0), ("a", 2, 3.0), ("a", 2, None), ("b", None, None)], "k string, j int, v double")
    found = protocols.latency(rows, "v", "k", "j")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(None, 1, 2, 7.0, 9.0, 9.0), ("a", 2, 1, 3.0, 3.0, 3.0)], key=str)
    assert [tuple(r) for r in protocols.latency(rows, "v").collect()] == [(3, 5.666667, 9.0, 9.0)]


def test_no_task_holds_the_values_of_a_key(spark):
    """No aggregate keeps all values of its group in one buffer."""
    from capsight.plans import ordered

    plan = ordered.percentiles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median" not in plan and "collect_" not in plan
