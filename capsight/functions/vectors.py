"""Vectors as bytes: little-endian 32-bit floats, as other stores keep them. Whole columns are re-read, not values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _encode(vectors: pa.Array) -> pa.Array:
    at = vectors.offsets.to_numpy()
    data = vectors.values.fill_null(float("nan")).cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4")
    rows = [data[a:b].tobytes() if ok else None for a, b, ok in zip(at[:-1], at[1:], vectors.is_valid().to_pylist(), strict=True)]
    return pa.array(rows, pa.binary())


def _decode(blobs: pa.Array) -> pa.Array:
    blobs = blobs.cast(pa.large_binary())
    _, offsets, data = blobs.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    size = np.diff(at)
    good = blobs.is_valid().to_numpy(zero_copy_only=False) & (size % 4 == 0)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    if (size % 4 != 0).any():  # bytes that are no vector are left out, so that the others stay aligned
        raw = np.concatenate([raw[a:b] for a, b, ok in zip(at[:-1], at[1:], good, strict=True) if ok] or [raw[:0]])
        starts = np.concatenate([[0], np.cumsum(np.where(good, size, 0))])
    else:
        raw, starts = raw[at[0] : at[-1]], at - at[0]
    values = pa.array(raw.view("<f4").astype(np.float32) if len(raw) else np.empty(0, np.float32))
    return pa.ListArray.from_arrays(pa.array((starts // 4).astype(np.int32)), values, mask=pa.array(~good))


def encoded(vector: Column) -> Column:
    """The vector's bytes; a null component is NaN."""

    @F.arrow_udf("binary")
    def run(vectors: pa.Array) -> pa.Array:
        return _encode(vectors)

    return run(vector.cast("array<float>"))


def decoded(blob: Column, dimension: int | None = None) -> Column:
    """The vector of some bytes; null if their number isn't divisible by four, or isn't that of ``dimension`` components."""

    @F.arrow_udf("array<float>")
    def run(blobs: pa.Array) -> pa.Array:
        return _decode(blobs)

    found = run(blob)
    return found if dimension is None else F.when(F.octet_length(blob) == 4 * dimension, found)
