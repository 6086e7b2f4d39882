"""The Voronoi search against all inner products in plain integers, and against the SQL."""

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsight.llm import voronoi_search
from capsight.llm.search_queries import OP12_SQL, op12_voronoi_topk
from capsight.llm.voronoi_search import best, top_products

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("unit", T.StringType()), T.StructField("vector", T.StringType()), T.StructField("score", T.LongType()),
    ]
)


def brute(rows, every, k=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for query in {i for i, _ in kept if i is not None and i % every == 0}:
        asks = min(v for i, v in kept if i == query)
        found = [(-sum(a * b for a, b in zip(asks, v, strict=False)), i is None, i or 0, i) for i, v in kept if i != query]
        out += [(query, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, every, k=10):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, top_products(frame, "vec_id", "embedding", F.col("vec_id") % every == 0, k).collect()), key=str)


def clusters(rng, n, length, near, count=8, scale=2.0):
    centres = [[rng.gauss(0, scale) for _ in range(length)] for _ in range(count)]
    return [[float(np.float32(x + rng.gauss(0, near))) for x in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("near", [0.01, 0.5, 5.0])
def test_same_as_all_products(spark, near, monkeypatch):
    monkeypatch.setattr(voronoi_search, "SLICE_BYTES", 8 * 6 * 40)  # slices of 40 rows
    rng = random.Random(int(near * 100))
    rows = [(i, v, "a", "b", 1) for i, v in enumerate(clusters(rng, 600, 6, near))]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_hot_vector_ties_repeats_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(voronoi_search, "SCORE_BYTES", 1 << 12)
    rng = random.Random(2)
    grid = [[float(rng.randrange(-1, 2)) for _ in range(4)] for _ in range(300)]
    rows = [(i, v, "a", "b", 1) for i, v in enumerate(grid)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0], "a", "b", 1) for i in range(300, 600)]  # one vector, a third of all rows and more
    rows += [rows[20], rows[20], rows[7], (20, [9.0, 9.0, 9.0, 9.0], "", "", 0), (None, [1.0] * 4, "", "", 0), (None, [2.0] * 4, "", "", 0)]
    rows += [(1000, None, "", "", 0), (1010, [float("nan")] * 4, "", "", 0), (1020, [None] * 4, "", "", 0), (1030, [0.0, 0.0, 0.0, float("inf")], "", "", 0)]
    rows += [(1040, [], "", "", 0), (1050, [3.0], "", "", 0), (-10, [0.5] * 4, "", "", 0)]
    rng.shuffle(rows)
    assert found(spark, rows, 10) == brute(rows, 10)
    assert found(spark, rows, 5, k=3) == brute(rows, 5, k=3)


def test_large_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.uniform(-100_000, 100_000))) for _ in range(6)], "", "", 0) for i in range(200)]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0, 2.0], "", "", 0), (1, [0.5, 0.5], "", "", 0), (2, [-1.0, 3.0], "", "", 0)]
    assert found(spark, rows, 2) == brute(rows, 2)
    assert found(spark, rows[:1], 2) == []
    assert found(spark, [], 2) == []


def test_far_cells_get_no_copy(spark, monkeypatch):
    """Of well separated clusters, queries go to few cells; on unstructured data to as many as it takes."""
    sent = []
    whole = voronoi_search.Cells.wanted
    rng = random.Random(4)
    rows = [(i, v, "", "", 0) for i, v in enumerate(clusters(rng, 800, 6, 0.05, count=12, scale=8.0))]
    data = voronoi_search.integer_vectors(spark.createDataFrame(rows, SCHEMA), "embedding", "vec_id")
    most = max(sum(x * x for x in r.vector) for r in data.collect())
    pivots = voronoi_search._pivots(data, "vec_id", len(rows), 6, most)
    inside = voronoi_search._in_cells(data, pivots)
    cells = voronoi_search._summaries(inside, "vec_id", len(pivots.points), 10)
    asked = [r for r in data.collect() if r.vec_id % 10 == 0]
    sent = whole(cells, pivots, 10, np.array([r.vector for r in asked], dtype=np.int64), np.array([r.vec_id for r in asked]))
    assert sent.sum() < 0.5 * sent.size
    assert found(spark, rows, 10) == brute(rows, 10)


def test_best_takes_the_first_of_equals():
    rng = np.random.default_rng(5)
    for k in (1, 3, 10):
        scores = rng.integers(0, 4, (50, 40))
        got = {}
        for r, c in zip(*best(scores, k), strict=True):
            got.setdefault(r, set()).add(c)
        assert got == {r: set(np.lexsort((np.arange(40), -scores[r]))[:k]) for r in range(50)}


def test_same_as_sql(spark):
    folder = Path("/root/testdata/sf0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = op12_voronoi_topk(spark, str(folder))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {','.join(got.columns)} FROM ({OP12_SQL})").fetchall())
