"""Streams that run: matching with state that expires, logs read once, a queue with timers; each stopped and started again."""

import datetime
import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsight.operators import protocols
from capsight.sources import event_log
from capsight.sources.event_log import Piece, lines_of, tail_start, whole_lines
from capsight.streaming import matching, windows, workers

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
DNS = "seq long, time timestamp, is_response boolean, id long, src string, dst string, name string"


def dns_rows(rng, n):
    rows = []
    for k in range(n):
        reply, client, name = rng.random() < 0.5, rng.choice(["a", "b", None]), rng.choice(["x", "y", None])
        rows.append((k, START + datetime.timedelta(seconds=30 * k + rng.random()), reply, rng.choice([1, 2, 3, None]), "s" if reply else client, client if reply else "s", name))
    return rows


def test_matches_survive_a_restart_and_equal_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = dns_rows(rng, 300)
    ends = [(10**6, START + datetime.timedelta(days=9), False, 99, "z", "s", None)]
    whole = spark.createDataFrame(rows, DNS)
    parts = [rows[:170], rows[170:] + ends]
    for part in parts:
        rng.shuffle(part)  # within the time that rows may be late

    def run(keep, name):
        folder = tmp_path / name
        stream = spark.readStream.schema(whole.schema).parquet(str(folder / "in"))
        return matching.run_available(matching.stream_matches(stream, keep, "3 hours"), str(folder / "out"), str(folder / "checkpoint"))

    for keep in (600.0, 10.0**7):
        name = f"k{int(keep)}"
        for k, part in enumerate(parts):
            spark.createDataFrame(part, DNS).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            found = run(keep, name)  # a new query each time: it goes on from the checkpoint
            assert k == 1 or found.count() < sum(r[2] for p in parts[: k + 1] for r in p)
        got = sorted(map(tuple, found.collect()), key=str)
        assert got == sorted(map(tuple, matching.recent_matches(whole, keep).select("seq", "id", "tier").collect()), key=str)
        if keep > 10**6:  # nothing expires: the unbounded look-back
            unbounded = protocols.dns_pairs(whole.where("id is not null and coalesce(src, 'q') <> '' and dst is not null and src is not null"))
            known = {r.seq for r in unbounded.select("seq").collect()}
            plain = matching.recent_matches(whole.where("id is not null and dst is not null and src is not null"), keep)
            assert {(r.seq, r.tier) for r in plain.collect()} == {(r.seq, r.tier) for r in unbounded.collect()} and known
    assert run(keep, name).count() == len(got)  # nothing new, nothing twice


def test_recent_matches_against_a_walk(spark):
    rows = dns_rows(random.Random(2), 300)
    expected = {}
    for k, (seq, at, reply, key, _, dst, name) in enumerate(rows):
        if reply:
            asked = [q for q in rows[:k] if not q[2] and q[3] == key and int(at.timestamp() * 1000) - int(q[1].timestamp() * 1000) <= 300_000]
            tiers = [t for t, met in ((1, [q for q in asked if dst is not None and q[4] == dst and q[6] == name]), (2, [q for q in asked if dst is not None and q[4] == dst]), (3, asked)) if met]
            expected[seq] = tiers[0] if tiers else None
    found = matching.recent_matches(spark.createDataFrame(rows, DNS), 300.0)
    assert {r.seq: r.tier for r in found.collect()} == expected


def test_log_lines_are_read_once_across_restarts(spark, tmp_path):
    logs, target = tmp_path / "logs", tmp_path / "target"
    logs.mkdir()
    (logs / "a.jsonl").write_bytes(b'{"n": 1}\n{"n": 2}\n{"n"')  # the third line isn't ended yet
    (logs / "b.jsonl").write_bytes(b"")
    (logs / "c.bin").write_bytes(b"no log\n")

    def run():
        events = event_log.parsed(event_log.stream(spark, str(logs)), "n long").select("file", "n")
        sink = windows.into_partitions(str(target / "rows"), "file")
        writer = events.withColumn("file", F.regexp_extract("file", "([a-z]+).jsonl", 1)).writeStream.foreachBatch(sink)
        writer.option("checkpointLocation", str(target / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema("batch long, n long, file string").parquet(str(target / "rows"))
        return sorted((r.file, -1 if r.n is None else r.n) for r in rows.collect())

    assert run() == [("a", 1), ("a", 2)]
    with (logs / "a.jsonl").open("ab") as f:
        f.write(b': 3}\r\nrubbish\n[4]\n{"n": "x"}\n{"n": 4}')
    (logs / "b.jsonl").write_bytes(b'{"n": 7}\n')
    assert run() == [("a", -1), ("a", 1), ("a", 2), ("a", 3), ("b", 7)]  # a field of another type is null
    with (logs / "a.jsonl").open("ab") as f:
        f.write(b"\n")
    (logs / "b.jsonl").write_bytes(b'{"n":8}\n')  # shorter: written anew
    found = run()
    assert found == [("a", -1), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 7), ("b", 8)]
    assert run() == found


@pytest.mark.parametrize("size", [1, 3, 16, 1000])
def test_pieces_and_tails_of_any_size(tmp_path, monkeypatch, size):
    monkeypatch.setattr(event_log, "READ", size)
    rng = random.Random(size)
    for k in range(30):
        lines = ["".join(rng.choice("aé\x0b") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(8))]
        text = "\n".join(lines) + rng.choice(["", "\n"]) * bool(lines)
        data, path = text.encode(), tmp_path / f"{k}.log"
        path.write_bytes(data)
        plain = data.split(b"\n")[: -1 if data.endswith(b"\n") or not data else None]
        for piece in (1, 2, 5, 100):
            cuts = [Piece(str(path), a, min(a + piece, len(data)), a == 0) for a in range(0, len(data), piece)]
            found = [x for c in cuts for x in lines_of(c)]
            assert [line for _, line in found] == plain
            assert all(data[at : at + len(line)] == line for at, line in found)
        for n in (1, 2, 5):
            start = tail_start(str(path), len(data), n)
            assert [line for _, line in lines_of(Piece(str(path), start, len(data), True))] == list(deque(plain, maxlen=n))
        assert whole_lines(str(path), len(data)) == data.rfind(b"\n") + 1


def test_tail_is_bounded(spark, tmp_path):
    (tmp_path / "x.log").write_text("".join(f"{k}\n" for k in range(50)))
    assert [r.line for r in event_log.tail(spark, str(tmp_path / "x.log"), 3).orderBy("offset").collect()] == ["47", "48", "49"]
    for bad in (0, 100_001):
        with pytest.raises(Exception, match="tail"):
            event_log.tail(spark, str(tmp_path), bad).collect()


def test_queue_gives_each_task_once_and_gives_up_silent_workers(spark, tmp_path):
    schema = "queue string, seq long, kind string, task_id long, worker string"
    kinds = T._parse_datatype_string(schema)
    first = [("q", 1, "queued", 10, None), ("q", 2, "queued", 11, None), ("q", 3, "queued", 12, None), ("q", 4, "cancelled", 11, None), ("q", 5, "claim", None, "a"), ("q", 6, "claim", None, "b"), ("q", 7, "claim", None, "c"), ("r", 1, "queued", 20, None)]
    second = [("q", 8, "done", 10, "a"), ("q", 9, "heartbeat", 12, "a"), ("r", 2, "claim", None, "a")]
    third = [("q", 10, "heartbeat", 12, "b"), ("q", 11, "claim", None, "d")]
    found = []
    before = spark.conf.get(matching.STORE[0], None)
    spark.conf.set(*matching.STORE)

    def start():
        rows = spark.readStream.schema(kinds).json(str(tmp_path / "in"))
        events = workers.queue_events(rows, "queue", 1.0, silent_ms=4000)
        writer = events.writeStream.foreachBatch(lambda batch, _: found.extend(tuple(r) for r in batch.collect()))
        return writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="300 milliseconds").start()

    def until(query, n):
        end = time.monotonic() + 90
        while len(found) < n and time.monotonic() < end and query.isActive:
            time.sleep(0.1)

    (tmp_path / "in").mkdir()
    try:
        spark.createDataFrame(first, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        query = start()
        until(query, 4)
        query.stop()
        assert sorted(found, key=str) == sorted([("q", 11, None, "cancelled"), ("q", 10, "a", "claimed"), ("q", 12, "b", "claimed"), ("q", None, "c", "nothing")], key=str)
        spark.createDataFrame(second, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        found.clear()
        query = start()  # claims are kept over the restart
        until(query, 5)  # the last ones come by the clock alone
        assert {("q", 12, "a", "rejected"), ("r", 20, "a", "claimed")} <= set(found)
        assert {f for f in found if f[3] in ("completed", "interrupted", "rejected") and f[1] == 10} in ({("q", 10, "a", "completed")}, {("q", 10, "a", "rejected"), ("q", 10, "a", "interrupted")})
        assert ("q", 12, "b", "interrupted") in found and ("r", 20, "a", "interrupted") in found
        found.clear()
        spark.createDataFrame(third, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        until(query, 2)
        query.stop()
        assert sorted(found, key=str) == sorted([("q", 12, "b", "rejected"), ("q", None, "d", "nothing")], key=str)
    finally:
        spark.conf.unset(matching.STORE[0]) if before is None else spark.conf.set(matching.STORE[0], before)
        for query in spark.streams.active:
            query.stop()
    assert workers.timeout_ms(1.0) == 15_000 and workers.timeout_ms(30.0) == 90_000
