"""Exact top-k search by inner product: a nearest-neighbour join over the Voronoi cells of pivots.

With one more component, sqrt(M - |x|^2) for data (M: the largest squared length) and 0 for queries,
the largest inner products are the smallest Euclidean distances, so the triangle inequality holds.
Data fall into the cells of their nearest pivots. A cell's summary - its number, least and greatest
distance to the pivot, and its k + 1 nearest ids - bounds how far a query's k-th neighbour can be, and
how near the cell can come to it. Only cells that can come that near get a copy of the query.

Cells over SLICE_BYTES, or over a task's share of all rows, are cut into slices by hash. A task
holds one slice of data as a matrix and streams the queries that were sent to it, so its memory
doesn't follow the number of queries. Bounds are rounded to the safe side; scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsight.llm.integer_vectors import exact_kind, integer_vectors, matrix
from capsight.llm.spark import written

#: Data vectors of a cell aimed at, and bounds of the number of pivots, which every task holds.
CELL_ROWS, LEAST_PIVOTS, MOST_PIVOTS = 65_536, 16, 1024
#: Bytes of a slice's matrix, and of the scores that a task holds at a time.
SLICE_BYTES, SCORE_BYTES = 1 << 26, 1 << 25
#: Part of the largest length that bounds give way by; float64 errs by far less.
SLACK = 1e-6
#: Stands for a null key inside tasks.
NO_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Pivots:
    """Pivots as integers (row, component), and the squared length that data are raised to."""

    points: np.ndarray
    most: int

    @property
    def slack(self) -> float:
        return SLACK * (1 + np.sqrt(self.most))

    def kind(self) -> type:
        return exact_kind(self.most)  # no inner product exceeds it, nor any sum on the way

    def _raised(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x * x).sum(1), 0).astype(np.float64))

    def distances(self, x: np.ndarray, raised: bool) -> np.ndarray:
        """Distances of the rows of ``x`` to all pivots; ``raised``: rows are data, not queries."""
        inner = (x.astype(self.kind()) @ self.points.astype(self.kind()).T).astype(np.float64)
        squares = (x * x).sum(1).astype(np.float64)[:, None] + self.most - 2 * inner
        if raised:
            height = self._raised(x)
            squares = 2 * self.most - 2 * inner - 2 * height[:, None] * self._raised(self.points)
        return np.sqrt(np.maximum(squares, 0))

    def between(self) -> np.ndarray:
        """Distances between pivots."""
        return self.distances(self.points, raised=True)


@dataclass(frozen=True)
class Cells:
    """What is known of each pivot's cell. ``near`` and ``near_ids``: its k + 1 rows next to the pivot; absent ones at infinity."""

    counts: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    near: np.ndarray
    near_ids: np.ndarray

    def wanted(self, pivots: Pivots, k: int, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(query, cell): whether the cell may hold one of the k nearest of the query that isn't its own row."""
        far = pivots.distances(x, raised=False)
        reach = np.where(self.near_ids == ids[:, None, None], np.inf, far[:, :, None] + self.near).reshape(len(x), -1)
        limit = np.partition(reach, k - 1, axis=1)[:, k - 1]  # there are k + 1 places for each cell
        own = far.argmin(1)
        # a row of another cell is nearer to that cell's pivot: it lies beyond the plane between the two
        apart = pivots.between()[own]
        plane = (far**2 - far[np.arange(len(x)), own][:, None] ** 2) / (2 * np.where(apart > 0, apart, np.inf))
        nearest = np.maximum(np.maximum(far - self.greatest, self.least - far), plane)
        return (self.counts > 0) & (nearest <= limit[:, None] + pivots.slack)


def _pivots(data: DataFrame, key: str, rows: int, width: int, most: int) -> Pivots:
    """Distinct vectors of the rows whose keys hash lowest: enough for cells of about CELL_ROWS."""
    n = min(MOST_PIVOTS, max(LEAST_PIVOTS, -(-rows // CELL_ROWS)))
    chosen = data.orderBy(F.xxhash64(key), "vector").limit(n).select("vector").toArrow()
    return Pivots(np.unique(matrix(chosen.column("vector").combine_chunks(), width), axis=0), most)


def _in_cells(data: DataFrame, pivots: Pivots) -> DataFrame:
    width = pivots.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = pivots.distances(matrix(batch.column("vector"), width), raised=True)
            cell = far.argmin(1).astype(np.int32)
            arrays = [*batch.columns, pa.array(cell), pa.array(far[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "cell", "distance"])

    fields = [*data.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())]
    return data.mapInArrow(run, T.StructType(fields))


def _summaries(data: DataFrame, key: str, pivots: int, k: int) -> Cells:
    """A row for each cell, and k + 1 more: as many as there are pivots, whatever the number of data."""
    whole = data.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("least"), F.max("distance").alias("greatest")).toArrow()
    first = Window.partitionBy("cell").orderBy("distance", F.col(key).asc_nulls_last())
    near = data.select("cell", "distance", key, F.row_number().over(first).alias("place")).where(F.col("place") <= k + 1).toArrow()
    counts, least, greatest = np.zeros(pivots, dtype=np.int64), np.zeros(pivots), np.zeros(pivots)
    cell = whole.column("cell").to_numpy()
    counts[cell], least[cell], greatest[cell] = (whole.column(c).to_numpy() for c in ("n", "least", "greatest"))
    at = near.column("cell").to_numpy(), near.column("place").to_numpy() - 1
    distances, ids = np.full((pivots, k + 1), np.inf), np.full((pivots, k + 1), NO_ID)
    distances[at], ids[at] = near.column("distance").to_numpy(), near.column(key).fill_null(NO_ID).to_numpy()
    return Cells(counts, least, greatest, distances, ids)


def _sent(asked: DataFrame, key: str, pivots: Pivots, cells: Cells, firsts: np.ndarray, slices: np.ndarray, k: int) -> DataFrame:
    """The queries, once for each slice of the cells that they need."""
    width, step = pivots.points.shape[1], max(1, SCORE_BYTES // (8 * cells.near.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                some = batch.slice(start, step)
                wanted = cells.wanted(pivots, k, matrix(some.column("vector"), width), some.column(key).to_numpy())
                units = [np.concatenate([np.arange(firsts[c], firsts[c] + slices[c]) for c in np.flatnonzero(row)] or [np.empty(0, int)]) for row in wanted]
                yield pa.RecordBatch.from_arrays(
                    [some.column(key), some.column("vector"), pa.array(units, pa.list_(pa.int32()))], names=[key, "vector", "units"]
                )

    fields = [asked.schema[key], asked.schema["vector"], T.StructField("units", T.ArrayType(T.IntegerType()))]
    return asked.select(key, "vector").mapInArrow(run, T.StructType(fields)).select(F.explode("units").alias("unit"), F.lit(True).alias("is_query"), key, "vector")


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of each row of an integer matrix; of equals the first columns."""
    if scores.shape[1] <= k:
        return tuple(i.ravel() for i in np.indices(scores.shape))
    least = np.partition(scores, -k, axis=1)[:, -k]
    over = scores > least[:, None]
    row, column = np.nonzero(over)
    missing = k - over.sum(1)
    level_row, level_column = np.nonzero(scores == least[:, None])
    place = np.arange(len(level_row)) - np.searchsorted(level_row, level_row)
    first = place < missing[level_row]
    return np.concatenate([row, level_row[first]]), np.concatenate([column, level_column[first]])


def _solved(units: DataFrame, key: str, width: int, most: int, k: int) -> DataFrame:
    """(query, key, score): the best k of each slice for each query sent to it.

    Rows come sorted by (unit, data before queries, key): a slice's matrix is built once, and queries
    stream by it.
    """
    kind, lowest, id_type = exact_kind(most), np.iinfo(np.int64).min, units.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, id_parts, data, ids = None, [], [], None, None
        for batch in batches:
            marks = batch.column("unit").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(marks[0]) != 0) | (np.diff(marks[1].astype(np.int8)) != 0)) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                some = batch.slice(start, stop - start)
                if not len(some):
                    continue
                if marks[0][start] != unit:
                    unit, parts, id_parts, data = marks[0][start], [], [], None
                vectors, own = matrix(some.column("vector"), width).astype(kind), some.column(key)
                if not marks[1][start]:
                    parts.append(vectors)
                    id_parts.append(own)
                    continue
                if data is None:
                    data = np.concatenate(parts) if parts else np.empty((0, width), kind)
                    ids = pa.concat_arrays(id_parts) if id_parts else own.slice(0, 0)
                    plain, parts, id_parts = ids.fill_null(NO_ID).to_numpy(), [], []
                step = max(1, SCORE_BYTES // (8 * max(1, len(data))))
                for at in range(0, len(vectors), step):
                    asked = own.slice(at, step)
                    scores = (vectors[at : at + step] @ data.T).astype(np.int64)
                    scores[asked.to_numpy()[:, None] == plain] = lowest
                    row, column = best(scores, k)
                    real = scores[row, column] > lowest
                    row, column = row[real], column[real]
                    yield pa.RecordBatch.from_arrays(
                        [asked.take(pa.array(row)), ids.take(pa.array(column)), pa.array(scores[row, column])], names=["query_id", key, "score"]
                    )

    fields = [T.StructField("query_id", id_type), T.StructField(key, id_type), T.StructField("score", T.LongType())]
    return units.select("unit", "is_query", key, "vector").mapInArrow(run, T.StructType(fields))


def top_products(vectors: DataFrame, key: str, vector: str, asked: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, key, score): the k rows with the highest integer inner product for each query. ``key`` is a bigint.

    Queries are the rows where ``asked`` holds; of rows of one key, the smallest vector asks. Rows of
    the query's own key are not its candidates; ties go to the smaller key, null keys last. Vectors that
    are null or hold null or non-finite components take no part; shorter ones end in zeros; repeated
    rows are candidates each. Integer components are held within 2**27. Other columns are not read;
    an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    data = integer_vectors(vectors, vector, key)
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda sum_, x: sum_ + x.cast("long") * x)
    rows, width, most = data.agg(F.count("*"), F.max(F.size("vector")), F.max(square)).first()
    kind = vectors.schema[key].dataType.simpleString()
    if not rows:
        return spark.createDataFrame([], f"query_id {kind}, rank int, `{key}` {kind}, score long")
    width = max(1, width)
    pivots = _pivots(data, key, rows, width, most)
    data = written(_in_cells(data, pivots), "cells")
    cells = _summaries(data, key, len(pivots.points), k)
    share = -(-rows // int(spark.conf.get("spark.sql.shuffle.partitions")))
    slice_rows = max(1, min(share, SLICE_BYTES // (8 * width)))
    slices = -(-cells.counts // slice_rows)
    firsts = np.cumsum(slices) - slices
    of_cell = lambda numbers: F.lit(numbers.astype(np.int32).tolist())[F.col("cell")]
    unit = of_cell(firsts) + F.pmod(F.xxhash64(key, "vector"), of_cell(np.maximum(slices, 1)).cast("long")).cast("int")
    asking = data.where(asked).groupBy(key).agg(F.min("vector").alias("vector"))
    both = data.select(unit.alias("unit"), F.lit(False).alias("is_query"), key, "vector").unionByName(
        _sent(asking, key, pivots, cells, firsts, slices, k)
    )
    dealt = both.repartition("unit").sortWithinPartitions("unit", "is_query", F.col(key).asc_nulls_last())
    found = _solved(dealt, key, width, most, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(key).asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
