"""Literal rows through the operators: values worked out by hand."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from capsight.functions import network, texts
from capsight.operators import capture, evidence, knowledge, protocols


def _packets(spark, rows):
    names = [f.name for f in capture.PACKET_SCHEMA.fields]
    base = {"ip.src": "192.0.2.10", "ip.dst": "198.51.100.7", "tcp.srcport": "50000", "tcp.dstport": "443", "direction": "upload"}
    return capture.typed(spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], capture.PACKET_SCHEMA))


def test_intervals_and_flows(spark):
    rows = _packets(spark, [{"frame.number": "1", "frame.time_relative": "1.999", "tcp.len": "1000000"}, {"frame.number": "2", "frame.time_relative": "2.000", "tcp.len": "500000"}])
    found = {r["interval_start"]: r["throughput_mbps"] for r in capture.intervals(rows, 2.0).collect()}
    assert found == {0.0: 4.0, 2.0: 2.0}
    rows = _packets(spark, [{"frame.time_relative": "1.0", "tcp.len": "1000000"}, {"frame.time_relative": "3.0", "tcp.len": "1000000", "direction": "download"}])
    (flow,) = capture.flows(rows).collect()
    assert (flow["flow_id"], flow["throughput_mbps"], flow["direction"]) == ("192.0.2.10:50000<->198.51.100.7:443", 8.0, "both")


def test_histogram_bounds(spark):
    rows = _packets(spark, [{"tcp.analysis.ack_rtt": x} for x in ("0.0005", "0.001", "0.005", "0.0101", "0.5", "1.5", "-1", "nan", "", "x")])
    (row,) = capture.summary(rows).collect()
    assert [b["count"] for b in row["rtt_histogram"]] == [2, 1, 0, 1, 0, 0, 0, 1, 0, 1]


def test_both_retransmission_marks_count_once_and_make_two_events(spark):
    rows = _packets(spark, [{"frame.number": "5", "tcp.analysis.retransmission": "1", "tcp.analysis.fast_retransmission": "true", "tcp.analysis.zero_window": "no"}])
    assert capture.summary(rows).first()["retransmission_count"] == 1
    assert {r["event_type"] for r in capture.events(rows).collect()} == {"retransmission", "fast_retransmission"}


def test_flow_id_orders_by_bytes_and_both_ways_agree(spark):
    frame = spark.createDataFrame([("9.0.0.1", 1, "10.0.0.9", 2), ("10.0.0.9", 2, "9.0.0.1", 1), ("2001:db8::2", 5, "2001:db8::10", 6), ("1.1.1.1", 1, "2001:db8::1", 2)], "a string, p int, b string, q int")
    ids = [r[0] for r in frame.select(network.flow_id(F.col("a"), F.col("p"), F.col("b"), F.col("q"), with_ipv6=True)).collect()]
    assert ids == ["9.0.0.1:1<->10.0.0.9:2", "9.0.0.1:1<->10.0.0.9:2", "[2001:db8::2]:5<->[2001:db8::10]:6", None]


def test_redaction_hashes_each_match(spark):
    frame = spark.createDataFrame([("from 10.1.2.3 to 10.1.2.30, mail a.b@example.org",), ("",), (None,)], "t string")
    first, empty, none = [r[0] for r in frame.select(texts.redacted(F.col("t"))).collect()]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()[:8]
    assert first == f"from <IP:{digest('10.1.2.3')}> to <IP:{digest('10.1.2.30')}>, mail <EMAIL:{digest('a.b@example.org')}>"
    assert empty == "" and none is None


def test_keyword_scores_of_every_occurrence(spark, monkeypatch):
    monkeypatch.setattr(knowledge, "PHRASE_BOUND", 2)
    texts = {1: "anananas x.y", 2: "X.Y \\E é été ÉTÉ", 3: None, 4: "", 5: "ana été", 6: "other", 7: "other one"}
    asked = [(1, "ana"), (1, "x.y"), (1, "an"), (2, "été"), (2, " nas "), (3, "absent"), (3, "")]
    docs = spark.createDataFrame(list(texts.items()), "k long, t string")
    found = knowledge.bm25(docs, "k", "t", spark.createDataFrame(asked, "query_id long, phrase string"))
    lowered = {k: (t or "").lower() for k, t in texts.items()}
    size = {k: max(len(t) - 2, 0) for k, t in lowered.items()}
    mean = sum(size.values()) / len(size)
    expected = {}
    for q, phrase in asked:
        if len(p := phrase.strip()) >= 3:
            f = {k: n for k, t in lowered.items() if (n := sum(t.startswith(p, i) for i in range(len(t))))}
            idf = max(math.log((len(texts) - len(f) + 0.5) / (len(f) + 0.5)), 1e-6)
            for k, n in f.items():
                part = idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[k] / mean))
                expected[q, k] = round(expected.get((q, k), 0.0) - part, 9)
    assert {(r["query_id"], r["k"]): round(r["score"], 9) for r in found.collect()} == pytest.approx(expected)
    assert knowledge.bm25(docs, "k", "t", spark.createDataFrame([], "query_id long, phrase string")).count() == 0


def test_tiers_of_replies(spark):
    rows = [(1, False, 7, "a", "s", "n"), (2, False, 7, "b", "s", None), (3, True, 7, "s", "a", "n"), (4, True, 7, "s", "b", None),
            (5, True, 7, "s", "b", "n"), (6, True, 7, "s", None, "n"), (7, True, 8, "s", "a", "n"), (8, False, 8, "a", "s", "n"), (9, True, None, "s", "a", "n")]
    frame = spark.createDataFrame(rows, "seq long, is_response boolean, id long, src string, dst string, name string")
    assert {r["seq"]: r["tier"] for r in protocols.dns_pairs(frame).collect()} == {3: 1, 4: 1, 5: 2, 6: 3, 7: None, 9: None}


def test_chunks_pack_and_overlap():
    assert knowledge.pack(["short"]) == ["short"]
    long = "x" * 3000
    assert [len(c) for c in knowledge.pack([long])] == [1500, 1500, 200]
    packed = knowledge.pack(["a" * 500, "b" * 500])
    assert packed == ["a" * 500, "a" * 100 + "\n\n" + "b" * 500]
    packed = knowledge.pack(["  a" * 10, "b" * 300 + "  ", "", "c" * 460, "d" * 699, "e" * 2, " ", long, "f"])
    assert [len(c) for c in packed] == [792, 801, 104, 1500, 1500, 200, 1]
    assert packed[0].startswith("a  a") and packed[1].startswith("c" * 100 + "\n\nd")


@pytest.mark.parametrize(
    "query",
    [
        {"fields": ["nope"]}, {"fields": []}, {"fields": ["tcp.len", "tcp.len"]}, {"limit": 0}, {"limit": 501}, {"offset": -1}, {"start": 2.0, "end": 1.0},
        {"predicates": [evidence.Predicate("tcp.len", "like", 1)]}, {"predicates": [evidence.Predicate("tcp.len", "in", [])]},
        {"predicates": [evidence.Predicate("tcp.len", "exists", 1)]}, {"flow_ids": ["x"] * 33},
    ],
)
def test_queries_outside_the_whitelist_are_refused(query):
    with pytest.raises(evidence.InvalidQuery):
        evidence.EvidenceQuery(**query)


def test_queries_beyond_the_bound_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(knowledge, "QUERY_BOUND", 5)
    vectors = [[float(k % 7 + 1), float(k % 5), float(k % 3) - 1] for k in range(30)]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    scores = knowledge.vector_scores(frame, "vec_id", "embedding", asked).withColumn("score", F.round("score", 9))
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in knowledge.top(scores, "vec_id", 4, True).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cosine = lambda v, w: round(sum(x * y for x, y in zip(v, w, strict=True)) / norm(v) / norm(w), 9)
    expected = {}
    for q in range(0, 30, 2):
        best = sorted(range(30), key=lambda k: (-cosine(vectors[q], vectors[k]), k))[:4]
        expected |= {(q, rank): k for rank, k in enumerate(best, 1)}
    assert found == expected
