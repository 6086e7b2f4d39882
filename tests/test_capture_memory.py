"""A reader lets go of the pieces of a file that it has read."""

import gc
import sys

import numpy as np

from capsight.sources import blocks, capture


def test_batches_do_not_keep_the_piece():
    data, start, zero = bytes(range(200)) * 2, np.arange(0, 400, 100), np.zeros(4, dtype=np.int64)
    piece = blocks.Frames(data, start, start + 60, zero + 60, zero, zero == 0, zero, zero, zero + 1, 1)
    reader = capture.CaptureReader.__new__(capture.CaptureReader)
    reader.names, reader.filters, reader.types = ["frame", "data"], [], capture._arrow_schema(["frame", "data"])
    before = sys.getrefcount(data)
    (batch,) = reader._batches("f", piece)
    assert batch.column("data").to_pylist() == [data[a : a + 60] for a in start]
    del batch
    gc.collect()
    assert sys.getrefcount(data) == before


def test_flow_ids_of_the_source_are_not_made_again_from_texts(spark):
    from capsight.operators import capture as packets
    from capsight.operators import wire
    from capsight.plans import wire as plans

    path = plans.capture_files(spark, "/root/testdata/sf0.001")
    names = ("frame", "time_ns", "ip_version", "src", "dst", "sport", "dport", "seq", "ack", "flags", "window", "tcp_len", "mss", "wscale", "sack")
    found = []
    for columns in (names, (*names, "flow_id")):
        rows = wire.packet_rows(wire.read(spark, path, *columns), plans.F.lit("upload"), plans.F.lit(0).cast("long"))
        flows = packets.typed(rows, with_ipv6=True).groupBy("flow_id").count()
        found.append((sorted(map(tuple, flows.collect())), "ipv6_key" in flows._jdf.queryExecution().toString()))
    assert found[0][0] == found[1][0] and [f[1] for f in found] == [True, False]
