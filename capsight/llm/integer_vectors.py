"""Vectors as integers: floor(1024 * x) of each component, and their exact arithmetic inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
#: Integer components beyond this count as this: sums of squares of 64 such differences fit in 64 bits.
MOST = 1 << 27


def integers(vector: Column) -> Column:
    """The components as array<int>: floor(1024 * x), x as double, held within MOST. Null or non-finite ones give null."""
    one = lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.when(~F.exists(vector, bad), F.transform(vector, one))


def integer_vectors(vectors: DataFrame, vector: str, *kept: str) -> DataFrame:
    """(kept columns, vector array<int>) of the rows whose vector is not null and holds only finite components."""
    return vectors.select(*kept, integers(F.col(vector)).alias("vector")).where("vector is not null")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list<int> column as a matrix; shorter ones are filled with zeros, longer ones cut."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    for size in np.unique(sizes):
        rows, n = np.flatnonzero(sizes == size), min(size, width)
        out[rows, :n] = flat[at[rows, None] + np.arange(n)]
    return out


def exact_kind(most: int) -> type:
    """The type in which products are exact if no sum of theirs exceeds ``most``: float64, which is fast, or int64."""
    return np.float64 if most < 1 << 53 else np.int64
