"""Capture files: framing, header decoding, payload stripping, writing by direction, pushed filters; on bytes written here."""

import io
import ipaddress
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from capsight.operators import evidence, wire
from capsight.sources import blocks, capture, headers
from capsight.sources.blocks import InvalidCapture, frames


def option(code, value, order):
    return struct.pack(order + "HH", code, len(value)) + value + b"\0" * (-len(value) % 4)


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def section(order="<"):
    return block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)


def interface(order="<", linktype=1, options=b""):
    return block(1, struct.pack(order + "HHI", linktype, 0, 0) + options, order)


def enhanced(data, ticks=0, order="<", which=0, original=None):
    return block(6, struct.pack(order + "IIIII", which, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data) if original is None else original) + data, order)


def legacy(data, ticks=0, order="<", which=0):
    return block(2, struct.pack(order + "HHIIII", which, 0, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data, order)


def simple(data, order="<", original=None):
    return block(3, struct.pack(order + "I", len(data) if original is None else original) + data, order)


def checksum(head):
    total = sum(struct.unpack(f">{len(head) // 2}H", head))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def tcp(sport, dport, seq=1, ack=2, flags=16, window=512, options=b"", payload=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, seq, ack, (5 + len(options) // 4) << 4, flags, window, 0, 0) + options + payload


def ipv4(src, dst, body, options=b"", protocol=6, fragment=0, total=None):
    size = 20 + len(options)
    head = struct.pack(">BBHHHBBH", 0x40 | size // 4, 0, size + len(body) if total is None else total, 1, fragment, 64, protocol, 0) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + options
    return head[:10] + struct.pack(">H", checksum(head)) + head[12:] + body


def ipv6(src, dst, body, first=6, extension=b""):
    return struct.pack(">IHBB", 6 << 28, len(extension) + len(body), first, 64) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + extension + body


def ethernet(body, kind=0x0800, tags=()):
    return b"\2" * 12 + b"".join(struct.pack(">HH", 0x8100, t) for t in tags) + struct.pack(">H", kind) + body


SYN_OPTIONS = b"\x02\x04\x05\xb4\x01\x03\x03\x07\x04\x02\x00\x00"
FOUR = ethernet(ipv4("192.0.2.10", "198.51.100.20", tcp(41000, 5201, 7, 9, 2, 100, SYN_OPTIONS, b"x" * 30)))
SIX = ethernet(ipv6("2001:db8::1", "2001:db8::2", tcp(50000, 443, payload=b"yy")), 0x86DD)
PACKETS = [
    FOUR, SIX, ethernet(ipv4("10.0.0.1", "10.0.0.2", tcp(1, 65535), options=b"\1" * 8)), ethernet(ipv4("10.0.0.1", "10.0.0.2", tcp(5, 6, payload=b"z")), tags=(5,)),
    ethernet(ipv4("10.0.0.1", "10.0.0.2", tcp(5, 6)), tags=(5, 6)) + b"\0" * 6, ethernet(ipv6("::1", "::2", tcp(8, 9, payload=b"q"), 0, b"\6\0" + b"\0" * 6), 0x86DD),
    ethernet(ipv6("::1", "::2", tcp(8, 9), 44, b"\6\0\0\1" + b"\0" * 4), 0x86DD), ethernet(ipv6("::1", "::2", tcp(8, 9), 44, b"\6\0\0\x09" + b"\0" * 4), 0x86DD),
    ethernet(ipv4("10.0.0.1", "10.0.0.2", b"\0" * 20, protocol=17)), ethernet(ipv4("10.0.0.1", "10.0.0.2", tcp(5, 6), fragment=3)), ethernet(b"\0" * 28, 0x0806),
    ethernet(ipv4("10.0.0.1", "10.0.0.2", tcp(5, 6, payload=b"p" * 9), total=0)), b"", b"\1" * 13, FOUR[:20], FOUR[:40], FOUR[:54], FOUR[:60], SIX[:50], SIX[:74],
    ethernet(ipv4("10.0.0.1", "10.0.0.2", tcp(5, 6, flags=18, options=b"\x02\x04\x05"))), ethernet(ipv4("10.0.0.1", "10.0.0.2", tcp(5, 6, options=b"\x03\x00\x00\x00"))),
    ethernet(ipv4("1.1.1.1", "1.1.1.1", tcp(9, 3))), ethernet(b"\x41" + b"\0" * 40), ethernet(ipv6("::ffff:1.2.3.4", "fe80::1:0:0:2", tcp(9, 3)), 0x86DD),
]


def literal(packet, original):
    """One packet's headers, byte by byte; None without TCP."""
    if len(packet) < 14:
        return None
    kind, at = struct.unpack_from(">H", packet, 12)[0], 14
    for _ in range(2):
        if kind == 0x8100 and len(packet) >= at + 4:
            kind, at = struct.unpack_from(">H", packet, at + 2)[0], at + 4
    if kind == 0x0800 and len(packet) >= at + 20 and packet[at] & 15 >= 5:
        size, protocol = (packet[at] & 15) * 4, packet[at + 9]
        if struct.unpack_from(">H", packet, at + 6)[0] & 0x1FFF:
            return None
        total = struct.unpack_from(">H", packet, at + 2)[0] or original - at
        src, dst = packet[at + 12 : at + 16], packet[at + 16 : at + 20]
    elif kind == 0x86DD and len(packet) >= at + 40:
        size, protocol, total = 40, packet[at + 6], 40 + struct.unpack_from(">H", packet, at + 4)[0]
        src, dst = packet[at + 8 : at + 24], packet[at + 24 : at + 40]
        while protocol in (0, 43, 60, 44):
            if protocol == 44 and struct.unpack_from(">H", packet, at + size + 2)[0] >> 3:
                return None
            protocol, size = packet[at + size], size + (8 if protocol == 44 else 8 * (packet[at + size + 1] + 1))
    else:
        return None
    l4 = at + size
    if protocol != 6 or len(packet) < l4 + 20:
        return None
    sport, dport, seq, ack, offset, _, window = struct.unpack_from(">HHIIBBH", packet, l4)
    offset = (offset >> 4) * 4
    mss = scale = None
    sack, place, stop = False, l4 + 20, min(l4 + offset, len(packet))
    while place < stop and packet[place]:
        if packet[place] == 1:
            place += 1
            continue
        length = packet[place + 1] if place + 1 < len(packet) else 0
        if length < 2 or place + length > stop:
            break
        if packet[place] == 2 and length == 4:
            mss = struct.unpack_from(">H", packet, place + 2)[0]
        if packet[place] == 3 and length == 3:
            scale = packet[place + 2]
        sack |= packet[place] == 4
        place += length
    flags = struct.unpack_from(">H", packet, l4 + 12)[0] & 0x1FF
    show = lambda a, p: f"[{ipaddress.ip_address(a)}]:{p}" if len(a) == 16 else f"{ipaddress.ip_address(a)}:{p}"
    ends = sorted([(src, sport), (dst, dport)])
    return {
        "src": str(ipaddress.ip_address(src)), "dst": str(ipaddress.ip_address(dst)), "sport": sport, "dport": dport, "seq": seq, "ack": ack,
        "flags": flags, "window": window, "tcp_len": max(0, total - size - offset), "mss": mss, "wscale": scale,
        "sack": sack if flags & 2 else None, "header_end": min(l4 + offset, len(packet)), "flow_id": "<->".join(show(*e) for e in ends),
    }


def write(path, *parts):
    path.write_bytes(b"".join(parts))
    return str(path)


def test_headers_equal_a_literal_parser(spark, tmp_path):
    rng = random.Random(1)
    noisy = [bytes(b if rng.random() < 0.97 else rng.randrange(256) for b in rng.choice(PACKETS)) for _ in range(300)]
    noisy = [p for p in noisy if struct.unpack(">H", p[12:14].ljust(2, b"\0"))[0] != 0x86DD]
    packets = PACKETS + noisy
    path = write(tmp_path / "a.pcapng", section(), interface(), *(enhanced(p, original=len(p) + 3) for p in packets))
    rows = wire.read(spark, path).orderBy("frame").collect()
    assert [bytes(r.data) for r in rows] == packets
    for row, packet in zip(rows, packets, strict=True):
        expected = literal(packet, len(packet) + 3)
        got = {c: row[c] for c in (expected or literal(FOUR, 1))}
        assert got == (expected or dict.fromkeys(got) | {"src": row.src, "dst": row.dst}), packet.hex()


def test_sections_orders_clocks_and_block_kinds(spark, tmp_path):
    nanos, binary = option(9, b"\x09", ">") + option(0, b"", ">"), option(9, b"\x8a", "<") + option(14, struct.pack("<q", 100), "<")
    path = write(
        tmp_path / "b.pcapng", section(), interface(), interface(options=binary), enhanced(FOUR, 1_500_000), block(4, b"name"), enhanced(SIX, 3 << 9, which=1), legacy(FOUR, 7),
        simple(SIX), simple(FOUR[:40], original=99), section(">"), interface(">", options=nanos), interface(">", linktype=101), block(0x0BAD, b"x", ">"),
        enhanced(FOUR, 1_700_000_000_123_456_789, ">"), simple(FOUR, ">"), legacy(FOUR, 5, ">"), enhanced(FOUR, 1, ">", which=1),
    )
    rows = wire.read(spark, path).orderBy("frame").collect()
    assert [r.frame for r in rows] == list(range(1, 10))
    assert [r.time_ns for r in rows] == [1_500_000_000, 101_500_000_000, 7000, None, None, 1_700_000_000_123_456_789, None, 5, 1000]
    assert [r.section for r in rows] == [0] * 5 + [1] * 4 and [r.linktype for r in rows] == [1] * 8 + [101]
    assert [(r.captured_len, r.original_len) for r in rows[3:5]] == [(len(SIX), len(SIX)), (40, 99)]
    assert rows[8].sport is None and rows[0].sport == 41000  # no Ethernet, no headers
    others = wire.read(spark, path, "frame", "block", "big_endian", blocks="true").where("block is not null").orderBy("frame").collect()
    assert [(r.frame, r.big_endian, bytes(r.block)) for r in others] == [(1, False, block(4, b"name")), (5, True, block(0x0BAD, b"x", ">"))]


@pytest.mark.parametrize("magic,order,tick", [(0xA1B2C3D4, "<", 1000), (0xA1B2C3D4, ">", 1000), (0xA1B23C4D, "<", 1), (0xA1B23C4D, ">", 1)])
def test_classic_captures(spark, tmp_path, magic, order, tick):
    head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    records = [struct.pack(order + "IIII", 10 + k, k, len(p), len(p) + 1) + p for k, p in enumerate(PACKETS)]
    rows = wire.read(spark, write(tmp_path / "c.pcap", head, *records)).orderBy("frame").collect()
    assert [(bytes(r.data), r.time_ns, r.original_len) for r in rows] == [(p, (10 + k) * 10**9 + k * tick, len(p) + 1) for k, p in enumerate(PACKETS)]


GOOD = section() + interface() + enhanced(FOUR)
BAD = {
    "header": GOOD + b"\1\0\0", "section": GOOD + section()[:10], "magic": section()[:8] + b"\0\0\0\0" + section()[12:], "short": GOOD + struct.pack("<III", 6, 28, 28),
    "aligned": GOOD + struct.pack("<II", 9, 13) + b"\0" * 20, "large": GOOD + struct.pack("<II", 9, 65 << 20), "remaining": GOOD + enhanced(FOUR)[:-4],
    "trailer": GOOD + enhanced(FOUR)[:-4] + b"\0\0\0\0", "captured": GOOD + block(6, struct.pack("<IIIII", 0, 0, 0, 999, 999) + FOUR), "no section": b"nothing of the kind",
}


@pytest.mark.parametrize("name", BAD)
def test_bad_files_end_in_one_error(spark, tmp_path, name):
    path = write(tmp_path / "d.pcapng", BAD[name])
    with pytest.raises(Exception, match="INVALID_CAPTURE"):
        wire.read(spark, path).collect()
    rows = wire.read(spark, path, mode="PERMISSIVE").collect()
    faults = [r for r in rows if r.error is not None]
    assert len(faults) == 1 and faults[0].error.startswith("INVALID_CAPTURE") and faults[0].data is None
    assert len(rows) - 1 == (0 if name in ("magic", "no section", "captured") else 1)


def test_folders_small_files_and_empty_ones(spark, tmp_path):
    for k in range(5):
        write(tmp_path / f"{k}.pcapng", GOOD)
    write(tmp_path / "empty.pcapng")
    write(tmp_path / "notes.txt", b"no capture")
    (tmp_path / "_staging").mkdir()
    write(tmp_path / "_staging" / "half.pcapng", b"bad")
    found = wire.read(spark, str(tmp_path), "file", "frame")
    assert found.count() == 5 and found.rdd.getNumPartitions() == 1
    assert wire.read(spark, str(tmp_path), "file", "frame").where(F.col("file").isin(str(tmp_path / "3.pcapng"), "x")).count() == 1
    with pytest.raises(Exception, match="nothing"):
        wire.read(spark, str(tmp_path / "nothing"), "file").collect()


@pytest.mark.parametrize("size", [13, 64, 1000])
def test_pieces_of_any_size_give_the_same_packets(monkeypatch, size):
    whole = section() + interface() + b"".join(enhanced(p, k) for k, p in enumerate(PACKETS)) + section(">") + interface(">") + b"".join(enhanced(p, k, ">") for k, p in enumerate(PACKETS))
    monkeypatch.setattr(blocks, "CHUNK", size)
    found = [(f.first + k, f.data[a:b], t) for f in frames(io.BytesIO(whole), len(whole)) for k, (a, b, t) in enumerate(zip(f.start, f.end, f.nanos, strict=True))]
    assert found == [(k + 1, p, (k % len(PACKETS)) * 1000) for k, p in enumerate(PACKETS * 2)]
    with pytest.raises(InvalidCapture):
        list(frames(io.BytesIO(whole[:-9]), len(whole) - 9))


def test_stripped_packets_keep_their_headers_and_have_valid_sums(spark, tmp_path):
    path = write(tmp_path / "e.pcapng", section(), interface(), *(enhanced(p, k) for k, p in enumerate(PACKETS)), simple(FOUR), simple(SIX))
    before = wire.read(spark, path)
    target = str(tmp_path / "out")
    wire.stripped(before).withColumn("direction", F.lit("x")).coalesce(1).sortWithinPartitions("frame").write.format(capture.NAME).mode("append").option("directions", "x").save(target)
    after = wire.read(spark, target).orderBy("frame").collect()
    for old, new in zip(before.orderBy("frame").collect(), after, strict=True):
        for c in ("src", "dst", "sport", "dport", "seq", "ack", "flags", "window", "mss", "wscale", "sack", "flow_id", "time_ns", "header_end"):
            assert new[c] == old[c], c
        if old.header_end is None or old.header_end == old.captured_len:
            assert (new.data, new.original_len) == (old.data, old.original_len)
            continue
        assert (new.captured_len, new.original_len, new.tcp_len) == (old.header_end, old.header_end, 0)
        data = bytes(new.data)
        at = data.index(b"\x08\x00", 12) + 2 if new.ip_version == 4 else None
        if at:
            assert checksum(data[at : at + (data[at] & 15) * 4]) == 0


def split(parts, target, overwrite=False):
    schema = pa.schema([("direction", pa.string()), ("data", pa.binary()), ("original_len", pa.int64()), ("time_ns", pa.int64())])
    from pyspark.sql.pandas.types import from_arrow_schema

    writer = capture.CaptureWriter(from_arrow_schema(schema), {"path": target}, overwrite)
    return writer, [lambda p=p: writer.write(iter([pa.RecordBatch.from_pylist(p, schema=schema)])) for p in parts]


def test_only_tasks_that_ended_well_leave_files(tmp_path):
    target = str(tmp_path / "t")
    rows = [{"direction": "upload", "data": FOUR, "original_len": len(FOUR), "time_ns": 5}, {"direction": "download", "data": SIX, "original_len": len(SIX), "time_ns": None}]
    writer, (first, other) = split([rows, rows[:1]], target)
    first()  # an attempt whose answer is lost
    writer.commit([first(), other(), None])
    found = {str(p.relative_to(tmp_path / "t")).split("/")[0] for p in (tmp_path / "t").rglob("*.pcapng")}
    assert found == {"upload", "download"} and len(list((tmp_path / "t").rglob("*.pcapng"))) == 3
    assert not list((tmp_path / "t").glob("_staging*"))
    writer, (first,) = split([rows], target)
    first()
    writer.abort([])
    assert len(list((tmp_path / "t").rglob("*.pcapng"))) == 3
    writer, (first,) = split([rows], target, overwrite=True)
    writer.commit([first()])
    assert len(list((tmp_path / "t").rglob("*.pcapng"))) == 2


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    capture.register(spark)
    rows = spark.range(4, numPartitions=2).select(
        F.lit("upload").alias("direction"), F.lit(FOUR).alias("data"), F.lit(5).cast("long").alias("original_len"),
        F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("time_ns"),
    )
    with pytest.raises(Exception, match="no"):
        rows.write.format(capture.NAME).mode("append").save(str(tmp_path / "f"))
    assert not list((tmp_path / "f").rglob("*.pcapng"))


def test_split_sends_flows_and_other_blocks_where_they_belong(spark, tmp_path):
    client, server = "192.0.2.10", "198.51.100.20"
    flow = lambda port, up, down: [
        ethernet(ipv4(client, server, tcp(port, 80, flags=2))), ethernet(ipv4(server, client, tcp(80, port, flags=18))),
        ethernet(ipv4(client, server, tcp(port, 80, payload=b"u" * up))), ethernet(ipv4(server, client, tcp(80, port, payload=b"d" * down))),
    ]
    no_syn = [ethernet(ipv4(client, server, tcp(4, 80, payload=b"u" * 900)))]
    packets = flow(1, 10, 900) + flow(2, 900, 10) + flow(3, 500, 500) + no_syn + [ethernet(b"\0" * 40, 0x0806)]
    path = write(tmp_path / "g.pcapng", section(">"), interface(">"), *(enhanced(p, k, ">") for k, p in enumerate(packets)), block(0x0BAD, b"kept", ">"))
    target = str(tmp_path / "split")
    flows = wire.split_by_direction(spark, path, target, 100, 0.7).collect()
    assert {(r.flow_id.split("<->")[0][-2:], r.category) for r in flows} == {(":1", "download"), (":2", "upload"), (":4", "unknown")}
    for direction, port in (("download", 1), ("upload", 2)):
        rows = wire.read(spark, f"{target}/{direction}", blocks="true").orderBy("frame", F.col("block").isNotNull()).collect()
        assert [(r.sport if r.sport != 80 else r.dport) for r in rows if r.block is None] == [port] * 4
        assert [r.time_ns for r in rows if r.block is None] == [1000 * (4 * (port - 1) + k) for k in range(4)]
        assert [bytes(r.block) for r in rows if r.block is not None] == [block(0x0BAD, b"kept", ">")]
        assert all(r.tcp_len == 0 for r in rows if r.block is None)


def test_evidence_predicates_are_pushed_and_change_nothing(spark, tmp_path):
    path = write(tmp_path / "h.pcapng", section(), interface(), *(enhanced(p, k) for k, p in enumerate(PACKETS * 3)), simple(FOUR))
    predicate = evidence.Predicate
    everything = wire.read(spark, path)
    plain = spark.createDataFrame(everything.collect(), everything.schema)
    cases = [
        [predicate("tcp.srcport", "eq", 5)], [predicate("tcp.srcport", "in", [5, 8, 41000])], [predicate("tcp.len", "gt", 1), predicate("tcp.ack", "lte", 9)],
        [predicate("ip.src", "exists", False)], [predicate("tcp.seq", "exists", True)], [predicate("tcp.dstport", "ne", 6)], [predicate("frame.number", "gte", 20), predicate("tcp.window_size", "lt", 513)],
    ]
    for null_safe in (False, True):
        for case in cases:
            query = evidence.EvidenceQuery(fields=("frame.number",), columns=wire.PACKET_COLUMNS, predicates=case, null_safe=null_safe, flow_ids=["10.0.0.1:5<->10.0.0.2:6", "1.1.1.1:3<->1.1.1.1:9"] if null_safe else ())
            pushed = evidence.matching(wire.read(spark, path), query)
            plan = pushed._jdf.queryExecution().executedPlan().toString()
            assert "Filter" not in plan.replace("RuntimeFilters", ""), plan
            expected = {r.frame for r in evidence.matching(plain, query).select("frame").collect()}
            assert {r.frame for r in pushed.select("frame").collect()} == expected
    text = wire.read(spark, path).where(F.col("flow_id").contains("10.0.0.1") & (F.col("sport") == 5) & F.col("data").isNotNull())
    assert text.count() == sum("10.0.0.1" in (x := literal(p, len(p)))["flow_id"] and x["sport"] == 5 for p in PACKETS * 3 if literal(p, len(p)))


def test_header_sums_fold_their_carry():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (200, 60)).astype(np.uint8)
    rows[0] = 255
    assert headers.header_sums(rows).tolist() == [checksum(r.tobytes()) for r in rows]
