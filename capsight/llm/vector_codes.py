"""Vector code compression: a codebook for each of four parts of the vectors, by Elkan's form of Lloyd's rounds.

Between rounds each part of each vector keeps an upper bound of its distance to its entry and one
lower bound for every entry, in a written table. Entries that moved shift the bounds by their
movement; only entries that the bounds and the distances between entries leave possible are
measured again. Pruning is strict - a bound must be below, not equal - and bounds are rounded to the
safe side, so what decides is always an integer distance, with ties to the lower index.

Each round is one narrow pass over the state and one sum per entry that tasks combine before the
shuffle. Codebooks (at most ENTRIES entries of the vectors' length) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsight.llm.integer_vectors import exact_kind, integer_vectors, matrix
from capsight.llm.spark import discard, written

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Levels of a stored lower bound, half a byte each: steps from the part's upper bound, under which none prunes, to its largest lower one.
LEVELS = 15
#: Distances are rounded by this fraction to the safe side; float64 errs by far less.
SLACK = 1e-9
#: Pairs measured at a time, and label totals' copies: a label that a third of all rows have is dealt over these.
PAIRS, SALTS = 1 << 18, 32


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, as exact integers."""
    xx, ee = (x * x).sum(1), (entries * entries).sum(1)
    kind = exact_kind(4 * max(int(xx.max(initial=0)), int(ee.max(initial=0))))
    return xx[:, None] + ee - 2 * (x.astype(kind) @ entries.astype(kind).T).astype(np.int64)


def _over(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK)


def _under(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - SLACK)


@dataclass
class Bounds:
    """For rows of one part: index of the entry, upper bound of its distance, lower bound of each entry's."""

    index: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def measured(x: np.ndarray, entries: np.ndarray) -> Bounds:
    """The nearest entries of all rows, by all distances."""
    squares = _squares(x, entries)
    index = squares.argmin(1)  # the first of equals
    return Bounds(index, _over(squares[np.arange(len(x)), index]), _under(squares))


def moved(bounds: Bounds, before: np.ndarray, after: np.ndarray) -> Bounds:
    """Bounds that hold once the entries ``before`` have become ``after``."""
    shift = _over(((after - before) ** 2).sum(1))
    upper = (bounds.upper + shift[bounds.index]) * (1 + SLACK)
    return Bounds(bounds.index, upper, np.maximum((bounds.lower - shift) * (1 - SLACK), 0))


def nearest(x: np.ndarray, entries: np.ndarray, bounds: Bounds) -> tuple[Bounds, int]:
    """The nearest entries of all rows, by only those distances that the bounds leave open; and their number."""
    between = _under(_squares(entries, entries)) / 2
    np.fill_diagonal(between, np.inf)
    rows = np.flatnonzero(bounds.upper >= between.min(1)[bounds.index])
    own = bounds.index[rows]
    best = ((x[rows] - entries[own]) ** 2).sum(1)
    upper = _over(best)
    open_ = (bounds.lower[rows] <= upper[:, None]) & (between[own] <= upper[:, None])
    index, lower = bounds.index.copy(), bounds.lower
    lower[rows, own] = _under(best)
    chosen, at, entry = own.copy(), *np.nonzero(open_)
    for first in range(0, len(at), PAIRS):
        r, j = at[first : first + PAIRS], entry[first : first + PAIRS]
        squares = ((x[rows[r]] - entries[j]) ** 2).sum(1)
        lower[rows[r], j] = _under(squares)
        least = best.copy()
        np.minimum.at(least, r, squares)
        chosen[least < best] = len(entries)  # a nearer one: any tie among the new ones decides
        tied = squares == least[r]
        np.minimum.at(chosen, r[tied], j[tied])
        best = least
    index[rows] = chosen
    tight = bounds.upper.copy()
    tight[rows] = _over(best)
    return Bounds(index, tight, lower), len(rows) + len(at)


# --- the written state -----------------------------------------------------------------------

def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a uint8 matrix as a binary column."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _numbers(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A binary column's rows as a matrix of ``width`` numbers each."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].view(np.uint8).copy().view(kind).reshape(len(column), width)


def _packed(levels: np.ndarray) -> np.ndarray:
    """Two columns of levels to a byte."""
    even = np.pad(levels, ((0, 0), (0, levels.shape[1] % 2)))
    return even[:, ::2] | even[:, 1::2] << 4


def _stored(parts: list[Bounds]) -> list[pa.Array]:
    """codes (a byte for each part), scales (upper bound and step, float64, for each part), lower (levels of each part's entries)."""
    step = np.stack([np.maximum(b.lower.max(1) - b.upper, 0) / LEVELS for b in parts], 1)
    safe = np.where(step > 0, step, 1)
    levels = [np.floor((b.lower - b.upper[:, None]) / safe[:, [p]]).clip(0, LEVELS).astype(np.uint8) for p, b in enumerate(parts)]
    levels = [np.where(step[:, [p]] > 0, found, 0) for p, found in enumerate(levels)]
    scales = np.stack([np.stack([b.upper for b in parts], 1), step], 2)
    codes = np.stack([b.index for b in parts], 1).astype(np.uint8)
    return [_binary(codes), _binary(scales.reshape(len(codes), -1).view(np.uint8)), _binary(np.concatenate([_packed(x) for x in levels], 1))]


def _restored(batch: pa.RecordBatch, k: int) -> list[Bounds]:
    codes = _numbers(batch.column("codes"), np.uint8, PARTS)
    scales = _numbers(batch.column("scales"), np.float64, 2 * PARTS).reshape(-1, PARTS, 2)
    packed = _numbers(batch.column("lower"), np.uint8, PARTS * -(-k // 2)).reshape(-1, PARTS, -(-k // 2))
    levels = np.stack([packed & LEVELS, packed >> 4], 3).reshape(len(codes), PARTS, -1)[:, :, :k]
    upper, step = scales[:, :, :1], scales[:, :, 1:]
    lower = np.where(levels > 0, (upper + levels * step) * (1 - SLACK), 0)
    return [Bounds(codes[:, p].astype(np.int64), scales[:, p, 0], lower[:, p]) for p in range(PARTS)]


STATE = ("codes", "scales", "lower")
TOTALS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _parts(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """(part, row, component) of the vectors of a batch; the last part ends in zeros if the length isn't divisible."""
    return matrix(batch.column("vector"), PARTS * size).reshape(batch.num_rows, PARTS, size).swapaxes(0, 1)


def _assigned(kept: DataFrame, state: DataFrame | None, before: np.ndarray | None, entries: np.ndarray) -> DataFrame:
    """``kept`` columns with the state under ``entries``: measured where there is no state, else by moved bounds."""
    source, fresh, (k, size) = kept if state is None else state, state is None, entries.shape[1:]
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _parts(batch, size)
            if fresh:
                found = [measured(x, e) for x, e in zip(parts, entries, strict=True)]
            else:
                old = [moved(b, *e) for b, *e in zip(_restored(batch, k), before, entries, strict=True)]
                found = [nearest(x, e, b)[0] for x, e, b in zip(parts, entries, old, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + _stored(found), names=[*names, *STATE])

    return source.mapInArrow(run, T.StructType([*kept.schema.fields, *(T.StructField(c, T.BinaryType()) for c in STATE)]))


def _recentred(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries that follow: floor(sum / count) of their parts by component; unused ones stay."""
    k, size = entries.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, k, size), dtype=np.int64), np.zeros((PARTS, k), dtype=np.int64)
        for batch in batches:
            codes = _numbers(batch.column("codes"), np.uint8, PARTS)
            for p, x in enumerate(_parts(batch, size)):
                np.add.at(sums[p], codes[:, p], x)
                counts[p] += np.bincount(codes[:, p], minlength=k)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": p.astype(np.int32), "entry": e.astype(np.int32), "n": counts[p, e], "sums": list(sums[p, e])}, TOTALS)

    totals = state.select("vector", "codes").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    whole = totals.select("part", "entry", "n", F.posexplode("sums").alias("at", "value")).groupBy("part", "entry", "at").agg(
        F.sum("value").alias("value"), F.sum("n").alias("n")
    ).toArrow()  # at most ENTRIES rows for each component
    part, entry, at, value, n = (whole.column(c).to_numpy() for c in ("part", "entry", "at", "value", "n"))
    found = entries.copy()
    found[part, entry, at] = value // n
    return found


def _first_entries(kept: DataFrame, key: str) -> np.ndarray:
    """The parts of the vectors of the ENTRIES smallest ids: (part, entry, component)."""
    rows = kept.orderBy(F.col(key).asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow()
    column = rows.column("vector").combine_chunks()
    longest = int(np.diff(column.offsets.to_numpy()).max(initial=0))
    size = -(-longest // PARTS)
    return matrix(column, PARTS * size).reshape(len(column), PARTS, size).swapaxes(0, 1)


def usable(vectors: DataFrame, vector: str, *kept: str) -> DataFrame:
    """(kept columns, vector array<int>) of the vectors that codes are for.

    Vectors that are null, empty, or hold null or non-finite components are dropped; so are those of
    another length than most have (of equally many, the longest).
    """
    found = integer_vectors(vectors, vector, *kept).where(F.size("vector") > 0)
    most = found.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return found.where(F.size("vector") == (most["length"] if most else 0))


@dataclass(frozen=True)
class Compressed:
    """codes: (key, carried columns, code, error); entries: the codebooks, (part, entry, component)."""

    codes: DataFrame
    entries: np.ndarray

    def sha256(self) -> str:
        """Digest of all components in order, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, key: str, vector: str, *carried: str) -> Compressed:
    """Codes of all usable vectors: four bytes as hex, and the squared error of what they stand for.

    The codebooks start as the parts of the ENTRIES smallest keys (a null key is the largest; of
    equal keys the smaller vector comes first) and see ROUNDS rounds. Lengths that four doesn't
    divide are filled with zeros. Repeated rows count as often as they stand. Integer components are
    held within 2**27. An empty table has no codes and no entries. Other columns are not read.
    """
    kept = usable(vectors, vector, key, *carried)
    entries, before, state = _first_entries(kept, key), None, None
    for number in range(ROUNDS if entries.size else 0):
        found = written(_assigned(kept, state, before, entries), f"codes-{number}")
        if state is not None:
            discard(state)
        state, before = found, entries
        entries = _recentred(state, entries)
    k, size = entries.shape[1:]
    names = [key, *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                nearest(x, e, moved(b, o, e))[0].index
                for x, b, o, e in zip(_parts(batch, size), _restored(batch, k), before, entries, strict=True)
            ]
            errors = sum(((x - e[i]) ** 2).sum(1) for x, e, i in zip(_parts(batch, size), entries, found, strict=True))
            codes = [row.tobytes().hex() for row in np.stack(found, 1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(codes, pa.string()), pa.array(errors)], names=[*names, "code", "error"])

    if state is None:
        codes = kept.select(*names, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        fields = [kept.schema[c] for c in names] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
        codes = written(state.mapInArrow(run, T.StructType(fields)), "codes")
        discard(state)
    return Compressed(codes, entries)


def with_group_total(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over rows of equal ``group``, nulls together.

    Totals are copied SALTS times and rows of a group dealt over the copies, so no task gets a whole group.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    totals = rows.groupBy(F.col(group).alias("_group")).agg(F.sum(value).alias(name)).withColumn("_copy", copies)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    same: Column = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_salt") == F.col("_copy"))
    return dealt.join(totals, same).drop("_group", "_copy", "_salt")
