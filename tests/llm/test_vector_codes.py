"""Vector codes against all distances in plain integers, and against the SQL."""

import hashlib
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from capsight.llm import vector_codes
from capsight.llm.code_queries import OP11_SQL, op11_vector_codes
from capsight.llm.vector_codes import compress, measured, moved, nearest

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
        T.StructField("code", T.StringType()), T.StructField("vector", T.StringType()), T.StructField("lower", T.LongType()),
    ]
)


def brute(rows):
    """The contract in plain Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // 4
    part = lambda v, p: tuple(v[p * size : (p + 1) * size])
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[part(v, p) for _, v, _ in kept[:256]] for p in range(4)]

    def assigned(p):
        return [min((far(part(v, p), e), i) for i, e in enumerate(books[p])) for _, v, _ in kept]

    for _ in range(4):
        for p in range(4):
            found = assigned(p)
            for i in {i for _, i in found}:
                mine = [part(v, p) for (_, v, _), (_, j) in zip(kept, found, strict=True) if i == j]
                books[p][i] = tuple(sum(xs) // len(mine) for xs in zip(*mine, strict=True))
    last = [assigned(p) for p in range(4)]
    errors = [sum(last[p][n][0] for p in range(4)) for n in range(len(kept))]
    totals = {}
    for (_, _, label), error in zip(kept, errors, strict=True):
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{last[p][n][1]:02x}" for p in range(4)), errors[n], totals[label], digest) for n, (i, _, label) in enumerate(kept)), key=str
    )


def found(spark, tmp_path, rows):
    folder = f"{tmp_path}/{len(rows)}"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return sorted(map(tuple, op11_vector_codes(spark, folder).collect()), key=str)


def vectors(rng, n, length=8, near=0.05):
    centres = [[rng.gauss(0, 0.3) for _ in range(length)] for _ in range(12)]
    return [[float(np.float32(x + rng.gauss(0, near))) for x in rng.choice(centres)] for _ in range(n)]


def test_same_as_all_distances(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, v, rng.choice([None, 1, 2, 3]), "x", "y", i) for i, v in enumerate(vectors(rng, 700))]
    rows += [(i + 1000, rows[5][1], 7, "x", "y", 0) for i in range(300)]  # one vector, many times
    rows += [rows[9], rows[9], (None, rows[3][1], None, None, None, None)]  # repeated rows, a null id
    rows += [(2000, None, 1, "", "", 0), (2001, [None] * 8, 1, "", "", 0), (2002, [float("nan")] + [0.0] * 7, 1, "", "", 0), (2003, [0.0] * 7 + [float("-inf")], 1, "", "", 0)]
    rng.shuffle(rows)
    assert found(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("grid", [1, 2])
def test_ties_go_to_the_lower_index(spark, tmp_path, grid):
    """Few distinct values: many equal distances, equal entries, and entries that are never used."""
    rng = random.Random(grid)
    rows = [(i, [rng.randrange(-grid, grid + 1) / 1024 for _ in range(8)], i % 2, "x", "y", i) for i in range(600)]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_fewer_vectors_than_entries(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, v, None, "x", "y", i) for i, v in enumerate(vectors(rng, 20))]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_large_components_are_exact(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.uniform(-60_000, 60_000))) for _ in range(8)], 1, "x", "y", i) for i in range(300)]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_empty_table_other_lengths_and_lengths_that_four_does_not_divide(spark, tmp_path):
    assert found(spark, tmp_path, []) == []
    rows = [(1, [0.5] * 6, 1, "", "", 0), (2, [0.25] * 6, 1, "", "", 0), (3, [1.0] * 5, 1, "", "", 0), (4, [], 1, "", "", 0)]
    got = compress(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    assert sorted(map(tuple, got.codes.collect())) == [(1, "00000000", 0), (2, "01010100", 0)]  # the last part is filled with zeros
    assert got.entries.shape == (4, 2, 2)
    assert compress(spark.createDataFrame(rows[3:], SCHEMA), "vec_id", "embedding").codes.collect() == []


def test_bounds_prune_and_never_hide_the_nearest():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-30, 31, (3000, 16))).astype(np.int64)
    entries = x[:40].copy()
    bounds = measured(x, entries)
    for number in range(5):
        after = entries.copy()
        for j in range(40):
            mine = x[bounds.index == j]
            after[j] = mine.sum(0) // len(mine) if len(mine) else entries[j]
        bounds, distances = nearest(x, after, moved(bounds, entries, after))
        entries = after
        everything = ((x[:, None] - entries) ** 2).sum(2)
        assert (bounds.index == everything.argmin(1)).all()
        assert (bounds.lower**2 <= everything).all() and (bounds.upper**2 >= everything.min(1)).all()
        assert distances < 3000 * 40 / (4 if number else 1)


def test_pairs_are_measured_in_pieces(monkeypatch):
    monkeypatch.setattr(vector_codes, "PAIRS", 7)
    rng = np.random.default_rng(6)
    x, entries = rng.integers(-3, 4, (200, 4)), rng.integers(-3, 4, (30, 4))
    start = measured(x, entries)
    after = entries + rng.integers(-1, 2, entries.shape)
    bounds, _ = nearest(x, after, moved(start, entries, after))
    assert (bounds.index == ((x[:, None] - after) ** 2).sum(2).argmin(1)).all()


@pytest.mark.parametrize("k", [1, 2, 7, 256])
def test_stored_bounds_hold(k):
    rng = np.random.default_rng(k)
    parts = []
    for _ in range(4):
        x, entries = rng.integers(-500, 500, (90, 4)), rng.integers(-500, 500, (k, 4))
        parts.append(measured(x, entries))
    batch = pa.RecordBatch.from_arrays(vector_codes._stored(parts), names=vector_codes.STATE)
    for before, after in zip(parts, vector_codes._restored(batch, k), strict=True):
        assert (before.index == after.index).all() and (before.upper == after.upper).all()
        assert (after.lower <= before.lower).all()
        lost = np.where(before.lower > before.upper[:, None], before.lower - after.lower, 0)
        assert (lost <= before.lower.max(1, keepdims=True) / 15 + np.where(after.lower == 0, before.upper[:, None], 0) + 1e-3).all()


def test_same_as_sql(spark):
    folder = Path("/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = op11_vector_codes(spark, str(folder))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {','.join(got.columns)} FROM ({OP11_SQL})").fetchall())
