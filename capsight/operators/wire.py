"""Packets from capture files to packet rows, to directions, and to captures without payload."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.operators import capture
from capsight.sources import headers
from capsight.sources import capture as source

SYN, ACK = 2, 16
#: Public field names of evidence queries and the columns of the source that hold them.
PACKET_COLUMNS = {
    "frame.number": "frame", "tcp.seq": "seq", "tcp.ack": "ack", "tcp.window_size": "window", "tcp.len": "tcp_len",
    "flow_id": "flow_id", "ip.src": "src", "ip.dst": "dst", "tcp.srcport": "sport", "tcp.dstport": "dport",
}


def read(spark: SparkSession, path: str, *columns: str, **options: str) -> DataFrame:
    """The packets of a capture file, or of all below a folder; only the named columns, if any are."""
    source.register(spark)
    reader = spark.read.format(source.NAME).options(**options)
    kinds = dict(part.split() for part in source.SCHEMA.split(", "))
    if columns:
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def packet_rows(frames: DataFrame, direction: Column, base_ns: Column) -> DataFrame:
    """Packets of the source as the text rows that ``capture.typed`` parses.

    What only a dissector knows - round trips, retransmissions - is null. ``base_ns``: the time that relative times count from.
    Frames with the source's ``flow_id`` keep it: made from bytes, it costs less than from texts.
    """
    text = lambda c: F.col(c).cast("string")
    four = F.col("ip_version") == 4
    flag = lambda bit: F.when(F.col("flags").bitwiseAND(bit) != 0, "1").when(F.col("flags").isNotNull(), "0")
    seconds = lambda ns: (ns.cast("decimal(20,0)") / F.lit(10**9)).cast("decimal(20,9)")
    known = {
        "frame.number": text("frame"), "frame.time_epoch": seconds(F.col("time_ns")).cast("string"),
        "frame.time_relative": seconds(F.col("time_ns") - base_ns).cast("string"),
        "ip.src": F.when(four, F.col("src")), "ip.dst": F.when(four, F.col("dst")), "ipv6.src": F.when(~four, F.col("src")), "ipv6.dst": F.when(~four, F.col("dst")),
        "tcp.srcport": text("sport"), "tcp.dstport": text("dport"), "tcp.seq": text("seq"), "tcp.ack": text("ack"), "tcp.len": text("tcp_len"),
        "tcp.window_size_value": text("window"), "tcp.flags.syn": flag(SYN), "tcp.flags.ack": flag(ACK), "tcp.options.mss_val": text("mss"),
        "tcp.options.wscale.shift": text("wscale"), "tcp.options.sack_perm": F.when(F.col("sack"), "1"),
    }
    rest = [F.lit(None).cast("string").alias(c) for c in capture.PACKET_FIELDS if c not in known]
    made = [c for c in ("flow_id",) if c in frames.columns]
    return frames.select(direction.alias("direction"), *[c.alias(name) for name, c in known.items()], *rest, *made)


def flow_categories(frames: DataFrame, min_bytes: float, min_ratio: float) -> DataFrame:
    """Flows of a capture with enough bytes on the wire, mostly one way: upload, download or, without a SYN, unknown.

    Frames need file, frame, src, sport, flow_id, flags and original_len; flows of different files are different.
    """
    opens = (F.col("flags").bitwiseAND(SYN) != 0) & (F.col("flags").bitwiseAND(ACK) == 0)
    rows = frames.where("flow_id is not null").select(
        F.concat_ws("|", "file", "flow_id").alias("_key"), F.concat_ws("|", "src", "sport").alias("side"), "frame", "original_len", opens.alias("opens")
    )
    found = capture.classify(rows, "_key", "side", "original_len", "frame", F.col("opens"), min_bytes, min_ratio)
    at = F.regexp_extract("_key", r"^(.*)\|([^|]*)$", 1), F.regexp_extract("_key", r"^(.*)\|([^|]*)$", 2)
    return found.select(at[0].alias("file"), at[1].alias("flow_id"), *[c for c in found.columns if c != "_key"])


def directed(frames: DataFrame, categories: DataFrame) -> DataFrame:
    """Frames with ``direction``: their flow's category; null for those of no upload or download, and for other blocks."""
    chosen = categories.where("category in ('upload', 'download')").select("file", "flow_id", F.col("category").alias("direction"))
    return frames.join(chosen, ["file", "flow_id"], "left")


def stripped(frames: DataFrame) -> DataFrame:
    """Frames whose TCP packets end with their headers: ``data``, ``captured_len`` and ``original_len`` are replaced.

    IP lengths tell the new size, and the sum of an IPv4 header is worked out anew. Packets without TCP, or
    without anything after the headers, stay. Extra columns are kept.
    """
    names, schema = frames.columns, frames.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            original = batch.column("original_len").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            packets = headers.Bytes.of(batch.column("data"))
            linktype = batch.column("linktype").fill_null(0).to_numpy(zero_copy_only=False) if "linktype" in names else np.full(len(original), source.ETHERNET)
            data, captured, wire = without_payload(packets, original, linktype == source.ETHERNET)
            valid = batch.column("data").is_valid()
            new = {"data": data, "captured_len": pa.array(captured), "original_len": pa.array(wire)}
            arrays = []
            for c in names:
                old = batch.column(c)
                arrays.append(pc.if_else(valid, new[c].cast(old.type), old) if c in new else old)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return frames.mapInArrow(run, schema)


def without_payload(packets: headers.Bytes, original: np.ndarray, ethernet: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(bytes, captured lengths, wire lengths) of packets cut where their TCP header ends."""
    h, size = headers.parse(packets, original), packets.end - packets.start
    cut = h.is_tcp & ethernet & (h.header_end < size)
    kept = np.where(cut, h.header_end, size)
    starts = np.concatenate([[0], np.cumsum(kept)])
    # the kept ranges one after another
    out = packets.data[np.repeat(packets.start - starts[:-1], kept) + np.arange(starts[-1])] if starts[-1] else np.empty(0, np.uint8)
    four, six = np.flatnonzero(cut & (h.version == 4)), np.flatnonzero(cut & (h.version == 6))

    def put(rows: np.ndarray, at: int, values: np.ndarray) -> None:
        places = starts[rows] + h.l3[rows] + at
        out[places], out[places + 1] = values >> 8, values & 0xFF

    put(four, 2, (kept - h.l3)[four])
    put(six, 4, (kept - h.l3 - 40)[six])
    put(four, 10, np.zeros(len(four), dtype=np.int64))
    length = (h.l4 - h.l3)[four]
    for n in np.unique(length):
        rows = four[length == n]
        put(rows, 10, headers.header_sums(out[(starts[rows] + h.l3[rows])[:, None] + np.arange(n)]))
    data = pa.Array.from_buffers(pa.large_binary(), len(kept), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(out)])
    return data.cast(pa.binary()), kept, np.where(cut, kept, original)


def split_by_direction(spark: SparkSession, path: str, target: str, min_bytes: float, min_ratio: float, strip: bool = True) -> DataFrame:
    """Writes the packets of upload and download flows of captures to ``target``, a folder each; returns the flows.

    Two passes over the files: headers only, to classify flows, and whole packets. Packets keep their order
    within a file, which one task reads and writes; blocks that are no packets go to both.
    """
    categories = flow_categories(read(spark, path, "file", "frame", "src", "sport", "flow_id", "flags", "original_len"), min_bytes, min_ratio)
    whole = read(spark, path, "file", "frame", "linktype", "time_ns", "captured_len", "original_len", "flow_id", "data", "big_endian", "block", blocks="true")
    rows = directed(whole, categories).repartition("file").sortWithinPartitions("file", "frame", F.col("block").isNotNull())
    rows = stripped(rows) if strip else rows
    rows.drop("file", "flow_id", "captured_len", "frame").write.format(source.NAME).mode("append").save(target)
    return categories
