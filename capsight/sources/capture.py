"""The data source ``capture``: packets of pcapng and pcap files as rows, and rows as pcapng files by direction.

Reading gives one row for each packet, its headers decoded (``SCHEMA``). A task reads whole files, small
ones several; headers of a piece are decoded together, filters that Spark pushes are tried on the
decoded columns, and only packets that pass have their bytes copied. A schema of fewer columns decodes
and sends only those.

Writing puts the packets of each direction into files of their own, through a staging folder: only files
of tasks that ended well are moved to where readers look.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from io import BufferedIOBase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from capsight.sources import headers
from capsight.sources.blocks import ENHANCED, ETHERNET, Frames, InvalidCapture, frames
from capsight.sources.storage import files_below, opened

NAME = "capture"
SUFFIXES = (".pcapng", ".pcap")
SCHEMA = (
    "file string, frame long, section int, interface int, linktype int, time_ns long, captured_len long, original_len long, "
    "ip_version int, src string, dst string, sport int, dport int, seq long, ack long, flags int, window int, tcp_len long, "
    "mss int, wscale int, sack boolean, flow_id string, header_end int, data binary, big_endian boolean, block binary, error string"
)
#: Bytes of small files that one task reads, rows of a batch.
PACK, ROWS = 128 << 20, 8192
#: Columns that only exist once a batch is made: no filter on them is pushed.
LATE = ("data", "block", "error")


def register(spark: SparkSession) -> None:
    """Makes ``capture`` known to a session, and lets Spark push filters into it."""
    spark.dataSource.register(CaptureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class CaptureSource(ds.DataSource):
    """Options: ``path``; ``mode``: FAILFAST (default) or PERMISSIVE, where a file that is no capture gives one row
    with ``error`` after the packets before the fault; ``blocks``: true for rows of blocks that are no packets
    (``block`` filled); when writing, ``directions``: the directions that get files, comma-separated.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return CaptureReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> ds.DataSourceArrowWriter:
        return CaptureWriter(schema, dict(self.options), overwrite)


# --- reading ----------------------------------------------------------------------------------

@dataclass
class Files(ds.InputPartition):
    """Files that one task reads."""

    files: list[tuple[str, int]]

    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(None)
        self.files = files


_SIMPLE = {
    ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal,
    ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal,
}


def condition(found: ds.Filter, columns: dict[str, pa.Array]) -> pa.Array:
    """The filter's truth for each row, null where SQL's is."""
    if isinstance(found, ds.Not):
        return pc.invert(condition(found.child, columns))
    column = columns[found.attribute[0]]
    if isinstance(found, ds.IsNull):
        return column.is_null()
    if isinstance(found, ds.IsNotNull):
        return column.is_valid()
    if isinstance(found, ds.In):
        values = pa.array([v for v in found.value if v is not None], column.type)
        hit = pc.if_else(column.is_valid(), pc.is_in(column, values), pa.scalar(None, pa.bool_()))
        return pc.if_else(hit, True, pa.scalar(None, pa.bool_())) if None in found.value else hit
    if isinstance(found, ds.EqualNullSafe):
        return column.is_null() if found.value is None else pc.fill_null(pc.equal(column, pa.scalar(found.value, column.type)), False)
    return _SIMPLE[type(found)](column, pa.scalar(found.value, column.type))


def _pushable(found: ds.Filter, names: Sequence[str]) -> bool:
    if isinstance(found, ds.Not):
        return _pushable(found.child, names)
    kinds = (*_SIMPLE, ds.In, ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)
    return isinstance(found, kinds) and len(found.attribute) == 1 and found.attribute[0] in names and found.attribute[0] not in LATE


class CaptureReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.path, self.names = options["path"], schema.names
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.others = options.get("blocks", "false").lower() == "true"
        self.filters: list[ds.Filter] = []
        unknown = set(self.names) - set(_parts(SCHEMA))
        if unknown:
            raise ValueError(f"capture has no column {sorted(unknown)[0]!r}")
        self.types = _arrow_schema(self.names)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Keeps the filters on decoded columns; Spark tries the others again. Rows of faults and other blocks have no decoded columns."""
        for found in filters:
            if _pushable(found, self.names):
                self.filters.append(found)
            else:
                yield found

    def partitions(self) -> Sequence[ds.InputPartition]:
        found = files_below(self.path, SUFFIXES)
        of_file = [f for f in self.filters if _columns(f) == {"file"}]
        if of_file and found:
            names = pa.array([name for name, _ in found])
            kept = _all(of_file, {"file": names}, len(found))
            found = [f for f, keep in zip(found, kept, strict=True) if keep]
        packs: list[list[tuple[str, int]]] = []
        room = 0
        for name, size in found:
            if size > room:
                packs.append([])
                room = PACK
            packs[-1].append((name, size))
            room -= size
        return [Files(pack) for pack in packs]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for name, size in partition.files:
            last = 0
            try:
                store, path = opened(name)
                with store.open_input_stream(path) as stream:
                    if path.lower().endswith(".pcapng") and size and stream.read(4) != b"\x0a\x0d\x0d\x0a":
                        raise InvalidCapture("no pcapng section header")
                with store.open_input_stream(path) as stream:
                    for piece in frames(stream, size, self.others):
                        last = piece.first + len(piece) - 1
                        yield from self._batches(name, piece)
            except InvalidCapture as fault:
                if not self.permissive:
                    raise InvalidCapture(f"{str(fault).removeprefix('INVALID_CAPTURE: ')} in {name} after packet {last}") from None
                yield from self._lone({"file": [name], "frame": [last + 1], "error": [str(fault)]})

    def _lone(self, values: dict[str, list]) -> Iterator[pa.RecordBatch]:
        """Rows that are no packets, if they pass the pushed filters."""
        n = len(next(iter(values.values())))
        columns = {c: pa.array(values.get(c, [None] * n), t) for c, t in zip(self.types.names, self.types.types, strict=True)}
        kept = pa.array(_all(self.filters, columns, n), pa.bool_())
        yield pa.RecordBatch.from_arrays([columns[c].filter(kept) for c in self.names], schema=self.types)

    def _batches(self, name: str, piece: Frames) -> Iterator[pa.RecordBatch]:
        wanted = set(self.names) | {c for f in self.filters for c in _columns(f)}
        for at in range(0, len(piece), ROWS):
            rows = slice(at, min(at + ROWS, len(piece)))
            columns = _decoded(name, piece, rows, wanted)
            keep = np.flatnonzero(_all(self.filters, columns, rows.stop - rows.start))
            if not len(keep):
                continue
            index = pa.array(keep)
            if "data" in wanted:
                # copies, since Arrow never lets go of a memoryview's buffer, and so of the whole piece
                ranges = zip(piece.start[rows][keep].tolist(), piece.end[rows][keep].tolist(), strict=True)
                columns["data"] = pa.array([piece.data[a:b] for a, b in ranges], pa.binary())
            empty = {c: pa.nulls(len(keep), self.types.field(c).type) for c in LATE if c in self.names}
            arrays = [columns["data"] if c == "data" else empty[c] if c in empty else columns[c].take(index) for c in self.names]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.types)
        if piece.others:
            before, big, blocks = map(list, zip(*piece.others, strict=True))
            yield from self._lone({"file": [name] * len(blocks), "frame": before, "big_endian": big, "block": blocks})


def _all(filters: Sequence[ds.Filter], columns: dict[str, pa.Array], n: int) -> np.ndarray:
    keep = np.ones(n, dtype=bool)
    for found in filters:
        keep &= condition(found, columns).fill_null(False).to_numpy(zero_copy_only=False)
    return keep


def _columns(found: ds.Filter) -> set[str]:
    return _columns(found.child) if isinstance(found, ds.Not) else {found.attribute[0]}


def _parts(schema: str) -> dict[str, str]:
    return dict(part.split() for part in schema.split(", "))


def _arrow_schema(names: Sequence[str]) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    parts = _parts(SCHEMA)
    return pa.schema([(c, kinds[parts[c]]) for c in names])


def _decoded(name: str, piece: Frames, rows: slice, wanted: set[str]) -> dict[str, pa.Array]:
    """The wanted columns of some packets but for their bytes; headers are only decoded if one of theirs is wanted."""
    kinds = _arrow_schema([c for c in _parts(SCHEMA) if c in wanted and c not in LATE])
    start, end = piece.start[rows], piece.end[rows]
    n, always = len(start), None
    columns: dict[str, tuple[np.ndarray, np.ndarray | None]] = {
        "frame": (piece.first + rows.start + np.arange(n), always), "section": (piece.section[rows], always), "interface": (piece.interface[rows], always),
        "linktype": (piece.linktype[rows], always), "time_ns": (piece.nanos[rows], piece.timed[rows]), "captured_len": (end - start, always),
        "original_len": (piece.original[rows], always), "big_endian": (np.zeros(n, dtype=bool), always),
    }
    found: dict[str, pa.Array] = {"file": pa.array([name], pa.string()).take(pa.array(np.zeros(n, dtype=np.int64)))}
    if set(kinds.names) - set(columns) - {"file"}:
        h = headers.parse(headers.Bytes(np.frombuffer(piece.data, dtype=np.uint8), start, end), piece.original[rows])
        ethernet = piece.linktype[rows] == ETHERNET
        h.is_ip, h.is_tcp = h.is_ip & ethernet, h.is_tcp & ethernet
        syn = h.is_tcp & (h.flags & 2 != 0)
        columns |= {
            "ip_version": (h.version, h.is_ip), "sport": (h.sport, h.is_tcp), "dport": (h.dport, h.is_tcp), "seq": (h.seq, h.is_tcp), "ack": (h.ack, h.is_tcp),
            "flags": (h.flags, h.is_tcp), "window": (h.window, h.is_tcp), "tcp_len": (h.payload, h.is_tcp), "mss": (h.mss, h.is_tcp & (h.mss >= 0)),
            "wscale": (h.scale, h.is_tcp & (h.scale >= 0)), "sack": (h.sack, syn), "header_end": (h.header_end, h.is_tcp),
        }
        version = np.where(h.is_ip, h.version, 0)
        for c, addresses in (("src", h.source), ("dst", h.target)):
            if c in kinds.names:
                found[c] = headers.address_texts(addresses, version)
        if "flow_id" in kinds.names:
            found["flow_id"] = headers.flow_texts(h)
    for c, t in zip(kinds.names, kinds.types, strict=True):
        if c not in found:
            values, valid = columns[c]
            found[c] = pa.array(values, mask=None if valid is None else ~valid).cast(t)
    return found


# --- writing ----------------------------------------------------------------------------------

@dataclass
class Written(ds.WriterCommitMessage):
    """(staged path, path below the target, packets) of the files of one task."""

    files: list[tuple[str, str, int]]


class _File:
    """A pcapng file in the making: a section for each byte order in turn, an interface for each link type in it."""

    def __init__(self, stream: BufferedIOBase) -> None:
        self.stream, self.order, self.links, self.packets = stream, "", {}, 0

    def _number(self, value: int, size: int) -> bytes:
        return value.to_bytes(size, self.order)

    def section(self, big: bool) -> None:
        order = "big" if big else "little"
        if order != self.order:
            self.order, self.links = order, {}
            n = self._number
            self.stream.write(n(0x0A0D0D0A, 4) + n(28, 4) + n(0x1A2B3C4D, 4) + n(1, 2) + n(0, 2) + b"\xff" * 8 + n(28, 4))

    def _link(self, linktype: int) -> int:
        if linktype not in self.links:
            n = self._number
            # if_tsresol: nanoseconds
            self.stream.write(n(1, 4) + n(32, 4) + n(linktype, 2) + n(0, 2) + n(0, 4) + n(9, 2) + n(1, 2) + b"\x09\0\0\0" + n(0, 4) + n(32, 4))
            self.links[linktype] = len(self.links)
        return self.links[linktype]

    def write_packets(self, data: list[bytes], original: np.ndarray, nanos: np.ndarray, timed: np.ndarray, linktype: np.ndarray) -> None:
        """Enhanced blocks; simple ones for packets without time that are whole (they have no place for an interface or a cut)."""
        self.section(False)
        order = np.uint32
        captured = np.array([len(d) for d in data], dtype=np.int64)
        padding = -captured % 4
        link = np.array([self._link(int(x)) for x in linktype], dtype=np.int64)
        simple = ~timed & (link == 0) & (captured == original)
        length = captured + padding + np.where(simple, 16, 32)
        fields = [np.full(len(data), ENHANCED), length, link, nanos >> 32, nanos & 0xFFFFFFFF, captured, original]
        enhanced = np.stack(fields, 1).astype(order)
        plain = np.stack([np.full(len(data), 3), length, original], 1).astype(order)
        tails = length.astype(order)
        parts: list[bytes] = []
        for k, packet in enumerate(data):
            parts += [plain[k].tobytes() if simple[k] else enhanced[k].tobytes(), packet, b"\0" * int(padding[k]), tails[k].tobytes()]
        self.stream.write(b"".join(parts))
        self.packets += len(data)

    def write_block(self, block: bytes, big: bool) -> None:
        self.section(big)
        self.stream.write(block)


class CaptureWriter(ds.DataSourceArrowWriter):
    """Takes columns direction, data, original_len, time_ns (null: none) and, if there, linktype, block, big_endian.

    A row with ``block`` is no packet: the block goes into the files of all directions. A packet of another
    direction, or of none, goes into no file. Packets keep the order of a task's rows.
    """

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool) -> None:
        missing = {"direction", "data", "original_len", "time_ns"} - set(schema.names)
        if missing:
            raise ValueError(f"capture needs a column {sorted(missing)[0]!r}")
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.directions = [d for d in options.get("directions", "download,upload").split(",") if d]
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, staging = opened(self.staging)
        attempt, files, streams = uuid.uuid4().hex, {}, []
        try:
            for direction in self.directions:
                store.create_dir(f"{staging}/{direction}", recursive=True)
            for batch in iterator:
                self._write_batch(batch, lambda d: files[d] if d in files else self._open(store, staging, d, attempt, files, streams))
        finally:
            for stream in streams:
                stream.close()
        return Written([(f"{self.staging}/{d}/{attempt}.pcapng", f"{d}/part-{attempt}.pcapng", f.packets) for d, f in files.items()])

    @staticmethod
    def _open(store, staging: str, direction: str, attempt: str, files: dict, streams: list) -> _File:  # noqa: ANN001
        streams.append(store.open_output_stream(f"{staging}/{direction}/{attempt}.pcapng"))
        files[direction] = _File(streams[-1])
        return files[direction]

    def _write_batch(self, batch: pa.RecordBatch, file_of) -> None:  # noqa: ANN001
        names, n = batch.schema.names, batch.num_rows
        column = lambda c, default: batch.column(c).fill_null(default).to_numpy(zero_copy_only=False) if c in names else np.full(n, default)
        direction = batch.column("direction").to_numpy(zero_copy_only=False)
        is_block = batch.column("block").is_valid().to_numpy(zero_copy_only=False) if "block" in names else np.zeros(n, dtype=bool)
        original, nanos, linktype = column("original_len", 0), column("time_ns", 0), column("linktype", ETHERNET)
        timed = batch.column("time_ns").is_valid().to_numpy(zero_copy_only=False)
        data = batch.column("data").to_pylist()
        start = 0
        for stop in [*np.flatnonzero(is_block), n]:  # packets between blocks that aren't, so the order stays
            for d in self.directions:
                mine = start + np.flatnonzero((direction[start:stop] == d) & ~is_block[start:stop])
                if len(mine):
                    file_of(d).write_packets([data[k] or b"" for k in mine], original[mine], nanos[mine], timed[mine], linktype[mine])
            if stop < n:
                for d in self.directions:
                    file_of(d).write_block(batch.column("block")[int(stop)].as_py(), bool(column("big_endian", False)[stop]))
            start = stop

    def commit(self, messages: list[Written | None]) -> None:
        """Moves the files of the tasks that ended well to their folders; those of other attempts go with the staging folder."""
        store, path = opened(self.path)
        old = [name for name, _ in files_below(self.path, SUFFIXES)] if self.overwrite else []
        for message in messages:
            for staged, name, _ in message.files if message else []:
                store.create_dir(f"{path}/{name.rpartition('/')[0]}", recursive=True)
                store.move(opened(staged)[1], f"{path}/{name}")
        for name in old:
            store.delete_file(opened(name)[1])
        self._clean(store)
        with store.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        """Leaves what was there before."""
        self._clean(opened(self.path)[0])

    def _clean(self, store) -> None:  # noqa: ANN001
        staging = opened(self.staging)[1]
        if store.get_file_info(staging).type.name == "Directory":
            store.delete_dir(staging)
