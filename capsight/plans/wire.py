"""Capture-file queries: ``events`` as packets go into pcapng files, and what is asked is read back from these.

``user_id`` gives a flow's client, ``event_type`` the sender and the SYN flag, ``value`` the payload, ``props.k`` the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.operators import capture, evidence, wire
from capsight.plans.packets import k_of
from capsight.plans.tables import table
from capsight.sources import capture as source
from capsight.sources.storage import shared_folder

PORT, MIN_BYTES, MIN_RATIO = 443, 6000, 0.55


def _hex(value: Column, size: int) -> Column:
    """A number as ``size`` bytes of hexadecimal digits."""
    return F.lpad(F.hex(value.cast("long")), 2 * size, "0")


def frames_of(events: DataFrame) -> DataFrame:
    """``events`` as Ethernet frames: IPv4, and IPv6 for each fifth user; options on SYN packets, payload of up to 1,399 bytes."""
    k, user = k_of(), F.col("user_id")
    asks, syn = F.col("event_type").isin("click", "purchase", "signup"), F.col("event_type") == "signup"
    six, size = user % 5 == 0, F.round(F.col("value") * 100).cast("long") % 1400
    client = F.when(six, F.concat(F.lit("20010db8" + "0" * 16), _hex(user, 4))).otherwise(F.concat(F.lit("0a"), _hex(user % (1 << 24), 3)))
    server = F.when(six, F.concat(F.lit("20010db8" + "0" * 15 + "1"), _hex(user % 4, 4))).otherwise(F.concat(F.lit("c63364"), _hex(user % 4, 1)))
    port = _hex(user % 60000 + 1024, 2)
    of = lambda mine, other: F.when(asks, mine).otherwise(other)
    options = F.when(syn, F.concat(F.lit("0204"), _hex(k % 4 * 100 + 1000, 2), F.lit("010303"), _hex(k % 8, 1), F.lit("04020101"))).otherwise("")
    tcp = F.concat(
        of(port, F.lit(f"{PORT:04x}")), of(F.lit(f"{PORT:04x}"), port), _hex(F.col("event_id"), 4), _hex(k, 4),
        F.when(syn, F.lit("80")).otherwise("50"), _hex(F.when(syn, 2).otherwise(0) + F.when(k % 3 == 0, 16).otherwise(0), 1), _hex(k * 512 % 65536, 2), F.lit("00000000"), options,
    )
    below = F.length(tcp) / 2 + size
    ip = F.when(six, F.concat(F.lit("60000000"), _hex(below, 2), F.lit("0640"), of(client, server), of(server, client))).otherwise(
        F.concat(F.lit("4500"), _hex(below + 20, 2), F.lit("00004000400600" + "00"), of(client, server), of(server, client))
    )
    head = F.concat(F.lit("02000000000102000000000286dd"), ip, tcp)
    head = F.when(six, head).otherwise(F.concat(F.lit("0200000000010200000000020800"), ip, tcp))
    return events.select(
        "event_id", "user_id", F.lit("all").alias("direction"), F.unhex(F.concat(head, F.repeat(F.lit("44"), size.cast("int")))).alias("data"),
        (F.length(head) / 2 + size).cast("long").alias("original_len"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"),
    )


def capture_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of pcapng files with the packets of ``events``; a flow is in one file."""
    source.register(spark)
    path = shared_folder(spark, "capture")
    rows = frames_of(table(spark, sf_dir, "events")).repartition("user_id").sortWithinPartitions("event_id").drop("event_id", "user_id")
    rows.write.format(source.NAME).mode("append").option("directions", "all").save(path)
    return path


def wire_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each flow, from files."""
    columns = ("frame", "time_ns", "ip_version", "src", "dst", "sport", "dport", "seq", "ack", "flags", "window", "tcp_len", "mss", "wscale", "sack", "flow_id")
    frames = wire.read(spark, capture_files(spark, sf_dir), *columns)
    base = table(spark, sf_dir, "events").agg((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) * 1000).alias("_base"))
    rows = wire.packet_rows(frames.crossJoin(F.broadcast(base)), F.when(F.col("dport") == PORT, "upload").otherwise("download"), F.col("_base"))
    packets = capture.typed(rows, with_ipv6=True)
    found = capture.flows(packets).select("flow_id", "direction", "n_packets", "n_bytes", "window_min", "window_max", "first_time", "last_time", "throughput_mbps")
    return found.select(*[F.round(c, 6).alias(c) if c in ("first_time", "last_time", "throughput_mbps") else c for c in found.columns])


def wire_syn_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the options of SYN packets, from files."""
    columns = ("frame", "time_ns", "ip_version", "src", "dst", "sport", "dport", "seq", "ack", "flags", "window", "tcp_len", "mss", "wscale", "sack")
    frames = wire.read(spark, capture_files(spark, sf_dir), *columns).where("flags >= 2")
    return capture.syn_options(capture.typed(wire.packet_rows(frames, F.lit("upload"), F.lit(0).cast("long")), with_ipv6=True))


def wire_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large flows that go mostly one way, with the packets and header bytes in the files of their direction."""
    path, target = capture_files(spark, sf_dir), shared_folder(spark, "directions")
    flows = wire.split_by_direction(spark, path, target, MIN_BYTES, MIN_RATIO).drop("file")
    found = wire.read(spark, target, "file", "flow_id", "captured_len", "tcp_len").groupBy("flow_id").agg(
        F.regexp_extract(F.first("file"), r"/(\w+)/[^/]*$", 1).alias("folder"), F.count("*").alias("n_packets"), F.sum("captured_len").alias("header_bytes"), F.sum("tcp_len").alias("payload_left"),
    )
    return flows.join(found, "flow_id", "left").select("flow_id", "category", "total_bytes", "folder", "n_packets", "header_bytes", "payload_left")


def wire_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that an evidence query asks for; its predicates are tried in the reader."""
    predicate = evidence.Predicate
    query = evidence.EvidenceQuery(
        fields=("tcp.seq", "tcp.len", "flow_id"), columns=wire.PACKET_COLUMNS,
        predicates=(predicate("tcp.len", "gte", 100), predicate("tcp.dstport", "eq", PORT), predicate("tcp.ack", "in", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]), predicate("tcp.window_size", "exists", True), predicate("tcp.seq", "ne", 7)),
    )
    frames = wire.read(spark, capture_files(spark, sf_dir), "seq", "tcp_len", "ack", "window", "dport", "flow_id")
    return evidence.matching(frames, query).select("seq", "tcp_len", "flow_id")


QUERIES = {f.__name__: f for f in (wire_flows, wire_syn_options, wire_directions, wire_evidence)}

_WIRE = f"""
    e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, user_id % 5 = 0 AS six, event_type IN ('click', 'purchase', 'signup') AS asks,
                 event_type = 'signup' AS syn, CAST(round(value * 100) AS BIGINT) % 1400 AS size FROM events),
    p AS (SELECT *, CASE WHEN six THEN '[2001:db8::' || CASE WHEN user_id >= 65536 THEN format('{{:x}}:', user_id // 65536) ELSE '' END || CASE WHEN user_id % 65536 = 0 AND user_id < 65536 THEN '' ELSE format('{{:x}}', user_id % 65536) END || ']'
                         ELSE '10.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) END || ':' || (user_id % 60000 + 1024) AS client,
                    CASE WHEN six THEN '[2001:db8::1:0:' || (user_id % 4) || ']' ELSE '198.51.100.' || (user_id % 4) END || ':{PORT}' AS server,
                    CASE WHEN six THEN 54 ELSE 34 END + CASE WHEN syn THEN 32 ELSE 20 END AS head FROM e),
    f AS (SELECT *, client || '<->' || server AS flow_id, k * 512 % 65536 AS win, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS sec FROM p)"""

ORACLE_SQL = {
    "wire_flows": f"""
        WITH {_WIRE}
        SELECT flow_id, CASE WHEN min(asks) = max(asks) THEN CASE WHEN min(asks) THEN 'upload' ELSE 'download' END ELSE 'both' END AS direction,
               count(*) AS n_packets, CAST(sum(size) AS BIGINT) AS n_bytes, min(win) AS window_min, max(win) AS window_max,
               round(min(sec), 6) AS first_time, round(max(sec), 6) AS last_time,
               round(CASE WHEN max(sec) > min(sec) THEN sum(size) * 8 / ((max(sec) - min(sec)) * 1e6) ELSE 0 END, 6) AS throughput_mbps
        FROM f GROUP BY flow_id""",
    "wire_syn_options": f"""
        WITH {_WIRE}
        SELECT option, value, count(*) AS n FROM (
          SELECT 'syn' AS option, '1' AS value FROM f WHERE syn UNION ALL SELECT 'mss', CAST(k % 4 * 100 + 1000 AS VARCHAR) FROM f WHERE syn
          UNION ALL SELECT 'window_scale', CAST(k % 8 AS VARCHAR) FROM f WHERE syn UNION ALL SELECT 'sack_permitted', '1' FROM f WHERE syn)
        GROUP BY ALL""",
    "wire_directions": f"""
        WITH {_WIRE},
        s AS (SELECT flow_id, sum(head + size) AS total, sum(head + size) FILTER (asks) AS up, count(*) AS n, sum(head) AS heads,
                     arg_min(asks, event_id) FILTER (syn AND k % 3 <> 0) AS client_asks FROM f GROUP BY 1),
        c AS (SELECT *, greatest(coalesce(up, 0), total - coalesce(up, 0)) / total AS ratio,
                     CASE WHEN client_asks IS NULL THEN 'unknown' WHEN coalesce(up, 0) > total - coalesce(up, 0) THEN 'upload' ELSE 'download' END AS category FROM s)
        SELECT flow_id, category, CAST(total AS BIGINT) AS total_bytes, CASE WHEN category <> 'unknown' THEN category END AS folder,
               CASE WHEN category <> 'unknown' THEN n END AS n_packets, CAST(CASE WHEN category <> 'unknown' THEN heads END AS BIGINT) AS header_bytes,
               CAST(CASE WHEN category <> 'unknown' THEN 0 END AS BIGINT) AS payload_left
        FROM c WHERE total >= {MIN_BYTES} AND ratio >= {MIN_RATIO}""",
    "wire_evidence": f"""
        WITH {_WIRE}
        SELECT event_id AS seq, size AS tcp_len, flow_id FROM f
        WHERE size >= 100 AND asks AND k IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND event_id <> 7""",
}
