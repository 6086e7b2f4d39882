"""The data source ``event_log``: lines of append-only files, as a table, its bounded tail, or a resumable stream.

A stream's offset is, for each file, the byte after the last whole line: a line that is still being
written waits for its end, and a query that is stopped and started again goes on at the next byte.
Long stretches are cut into pieces that tasks read side by side; a piece has the lines that begin in it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsight.functions.texts import whole_json
from capsight.sources.storage import files_below, opened

NAME = "event_log"
SCHEMA = "file string, offset long, line string"
SUFFIXES = (".jsonl", ".json", ".log", ".txt")
#: Bytes of a piece, of a read, rows of a batch.
PIECE, READ, ROWS = 64 << 20, 1 << 20, 8192
LEAST_TAIL, MOST_TAIL = 1, 100_000


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLogSource)


class EventLogSource(ds.DataSource):
    """Options: ``path``, a file or a folder; ``tail``, 1 to 100,000: only so many last lines of each file (not for streams)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return EventLogReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> ds.DataSourceStreamReader:
        return EventLogStream(dict(self.options))


@dataclass
class Piece(ds.InputPartition):
    """The lines of a file that begin in [start, stop). ``aligned``: a line begins at start."""

    file: str
    start: int
    stop: int
    aligned: bool

    def __init__(self, file: str, start: int, stop: int, aligned: bool) -> None:
        super().__init__(None)
        self.file, self.start, self.stop, self.aligned = file, start, stop, aligned


def _pieces(file: str, start: int, stop: int) -> list[Piece]:
    cuts = list(range(start, stop, PIECE))
    return [Piece(file, at, min(at + PIECE, stop), at == start) for at in cuts]


def _backwards(file: str, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of a file's pieces from ``stop`` to its begin."""
    store, path = opened(file)
    with store.open_input_file(path) as source:
        while stop > 0:
            start = max(0, stop - READ)
            source.seek(start)
            yield start, source.read(stop - start)
            stop = start


def whole_lines(file: str, size: int) -> int:
    """The byte after the last line of ``file`` that has an end, within its first ``size`` bytes."""
    return next((at + data.rindex(b"\n") + 1 for at, data in _backwards(file, size) if b"\n" in data), 0)


def tail_start(file: str, size: int, n: int) -> int:
    """The byte where the last ``n`` lines of ``file`` begin; an unended last line is one."""
    wanted = n
    for at, data in _backwards(file, size):
        end = len(data)
        if at + end == size and data.endswith(b"\n"):
            end -= 1
        while (end := data.rfind(b"\n", 0, end)) >= 0:
            wanted -= 1
            if wanted == 0:
                return at + end + 1
    return 0


def lines_of(piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of the lines that begin in a piece."""
    store, path = opened(piece.file)
    with store.open_input_file(path) as source:
        at, kept = piece.start, b""
        if not piece.aligned:  # the line that the piece before has begun ends first
            at -= 1
        source.seek(at)
        skip = not piece.aligned
        while at < piece.stop:
            data = source.read(READ)
            if not data:
                if kept and not skip:
                    yield at, kept
                return
            kept += data
            *lines, kept = kept.split(b"\n")
            for line in lines:
                if at >= piece.stop:
                    return
                if not skip:
                    yield at, line.removesuffix(b"\r")
                skip, at = False, at + len(line) + 1


def _batches(pieces: Sequence[Piece]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("line", pa.string())])
    for piece in pieces:
        rows: list[tuple[int, str]] = []

        def batch(rows: list[tuple[int, str]], file: str = piece.file) -> pa.RecordBatch:
            offsets, lines = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(offsets), pa.array(lines)], schema=schema)

        for at, line in lines_of(piece):
            rows.append((at, line.decode("utf-8", "replace")))
            if len(rows) == ROWS:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


class EventLogReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.tail = options["path"], int(options.get("tail", 0))
        if "tail" in options and not LEAST_TAIL <= self.tail <= MOST_TAIL:
            raise ValueError("tail must be 1 to 100000")

    def partitions(self) -> Sequence[ds.InputPartition]:
        found = []
        for file, size in files_below(self.path, SUFFIXES):
            found += _pieces(file, tail_start(file, size, self.tail) if self.tail else 0, size)
        return found

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _batches([partition])


class EventLogStream(ds.DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "tail" in options:
            raise ValueError("a stream has no tail")
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({file: whole_lines(file, size) for file, size in files_below(self.path, SUFFIXES)}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[ds.InputPartition]:
        """Pieces of what was added. A file that has become shorter was written anew: it is read from its begin."""
        before = json.loads(start["files"])
        found = []
        for file, stop in json.loads(end["files"]).items():
            at = before.get(file, 0)
            found += _pieces(file, at if at <= stop else 0, stop)
        return found

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _batches([partition])


def tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last ``n`` lines of each file."""
    register(spark)
    return spark.read.format(NAME).option("tail", n).load(path)


def stream(spark: SparkSession, path: str) -> DataFrame:
    """All lines, as they come."""
    register(spark)
    return spark.readStream.format(NAME).load(path)


def parsed(lines: DataFrame, fields: str, line: str = "line") -> DataFrame:
    """``lines`` with the fields of their JSON objects; blank lines and those that are no such object are left out.

    A field of another type is null.
    """
    found: Column = F.from_json(line, fields, {"mode": "PERMISSIVE"})
    is_object = F.col(line).rlike(r"^\s*\{") & whole_json(F.col(line))
    rest = [c for c in lines.columns if c != line]
    return lines.where(is_object).withColumn("_found", found).select(*rest, "_found.*")
