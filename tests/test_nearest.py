"""Exact searches whose work stays in the tasks."""

import math

import pytest
from pyspark.sql import functions as F

from capsight.operators import knowledge
from capsight.plans import decisions, retrieval

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("others", [False, True])
def test_nearest_equals_all_pairs(spark, monkeypatch, others):
    monkeypatch.setattr(knowledge, "QUERY_BOUND", 5)
    vectors = {k: [float(k % 7 + 1), float(k % 5), float(k % 3) - 1] for k in range(60)}
    vectors |= {k + 100: [2 * x for x in vectors[k]] for k in range(20)} | {k + 200: vectors[3] for k in range(40)}
    odd = {300: None, 301: [], 302: [0.0, 0.0, 0.0], 303: [1.0, float("nan"), 1.0], 304: [1.0, None, 1.0], 305: [float("inf"), 1.0, 1.0], 306: [1.0, 2.0]}
    frame = spark.createDataFrame([*vectors.items(), *odd.items()], "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = {(r.query_id, r["rank"]): (r.k, r.score) for r in knowledge.nearest(frame.withColumnRenamed("vec_id", "k"), "k", "embedding", asked, 6, others=others).collect()}
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    cosine = lambda v, w: round(sum(x / norm(v) * (y / norm(w)) for x, y in zip(v, w, strict=True)), 9)
    expected = {}
    for q in (q for q in vectors if q % 3 == 0):
        best = sorted((-cosine(vectors[q], v), k) for k, v in vectors.items() if not (others and k == q))[:6]
        expected |= {(q, rank): (k, -score) for rank, (score, k) in enumerate(best, 1)}
    lone = {key: value for key, value in found.items() if key[0] not in expected and key[0] == 306}
    assert lone == ({} if others else {(306, 1): (306, 1.0)})
    assert {key: value for key, value in found.items() if key not in lone} == expected


def test_rounding_is_that_of_spark(spark):
    import numpy as np

    values = [0.1234567885, -0.1234567885, 0.5000000005, -0.0000000005, 2.5e-10, 0.9999999995, 1.0, -12.3456789125]
    spark_rows = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9).alias("x")).collect()]
    assert knowledge.half_up(np.array(values), 9).tolist() == spark_rows


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [retrieval.vector_topk, decisions.overfetch_topk])
def test_searches_pair_no_rows_in_joins(spark, query):
    assert "NestedLoopJoin" not in _plan(query(spark, SF)) and "Cartesian" not in _plan(query(spark, SF))
