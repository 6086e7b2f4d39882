"""Capture queries over ``events`` read as packets: flows, intervals, coverage, histograms, anomaly events, pages.

``event_type`` gives a packet's direction and markers, ``props.k`` its window and options, ``user_id`` its flow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.functions import fields
from capsight.operators import capture, evidence, rules
from capsight.plans.tables import table

INTERVAL = 3600.0


def k_of(props: str = "props") -> Column:
    """The number in an event's props."""
    return F.regexp_extract(props, "[0-9]+", 0).cast("long")


def seconds_since_first(events: DataFrame) -> DataFrame:
    """Events with ``time``: seconds since the first one."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first = events.agg(F.min(micros).alias("_first"))
    return events.crossJoin(F.broadcast(first)).withColumn("time", (micros - F.col("_first")) / F.lit(1e6)).drop("_first")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as typed packets."""
    rows = seconds_since_first(table(spark, sf_dir, "events")).withColumn("k", k_of())
    kind, k = F.col("event_type"), F.col("k")
    return rows.select(
        F.when(kind.isin("click", "purchase"), "upload").otherwise("download").alias("direction"),
        (F.col("event_id") + 1).alias("frame"), F.when(k % 10 != 0, F.col("time")).alias("time"), F.col("time").cast("decimal(20,9)").alias("epoch"),
        F.col("value").alias("rtt_ms"), F.round(F.col("value") * 100).cast("long").alias("n_bytes"), (k * 512).alias("window"),
        F.col("event_id").alias("tcp_seq"), k.alias("tcp_ack"), ((kind != "signup") | (k % 5 != 0)).alias("is_tcp"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("flow_id"),
        (kind == "signup").alias("syn"), (k % 3 == 0).alias("ack"), (k % 4 * 100 + 1000).cast("string").alias("mss"),
        (k % 8).cast("string").alias("wscale"), (k % 2 == 0).alias("sack"),
        ((kind == "error") & (k % 2 == 0)).alias("retransmission"), ((kind == "error") & (k % 4 == 0)).alias("fast_retransmission"),
        ((kind == "view") & (k % 7 == 0)).alias("duplicate_ack"), ((kind == "click") & (k % 11 == 0)).alias("out_of_order"),
        ((kind == "purchase") & (k % 9 == 0)).alias("zero_window"), ((kind == "purchase") & (k % 8 == 0)).alias("window_full"),
    )


PACKETS = """
    e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
                 (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS sec FROM events),
    p AS (SELECT CASE WHEN event_type IN ('click', 'purchase') THEN 'upload' ELSE 'download' END AS direction,
                 event_id + 1 AS frame, CASE WHEN k % 10 <> 0 THEN sec END AS time, sec AS epoch, value AS rtt_ms,
                 CAST(round(value * 100) AS BIGINT) AS n_bytes, k * 512 AS window_size, event_id AS tcp_seq, k AS tcp_ack,
                 (event_type <> 'signup' OR k % 5 <> 0) AS is_tcp, 'u' || user_id AS flow_id,
                 event_type = 'signup' AS syn, k % 4 * 100 + 1000 AS mss, k % 8 AS wscale, k % 2 = 0 AS sack,
                 event_type = 'error' AND k % 2 = 0 AS retransmission, event_type = 'error' AND k % 4 = 0 AS fast_retransmission,
                 event_type = 'view' AND k % 7 = 0 AS duplicate_ack, event_type = 'click' AND k % 11 = 0 AS out_of_order,
                 event_type = 'purchase' AND k % 9 = 0 AS zero_window, event_type = 'purchase' AND k % 8 = 0 AS window_full
          FROM e)"""
_METRICS = """count(*) AS n_packets, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, min(window_size) AS window_min, max(window_size) AS window_max,
    count(*) FILTER (retransmission OR fast_retransmission) AS retransmission_count, count(*) FILTER (duplicate_ack) AS duplicate_ack_count,
    count(*) FILTER (out_of_order) AS out_of_order_count, count(*) FILTER (zero_window) AS zero_window_count,
    count(*) FILTER (window_full) AS window_full_count"""


def capture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over all TCP packets, and bytes by direction."""
    return capture.summary(packets(spark, sf_dir)).drop("rtt_histogram")


def flow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics, direction, duration and throughput per flow."""
    found = capture.flows(packets(spark, sf_dir)).drop("rtt_histogram")
    return found.select(*[F.round(c, 6).alias(c) if c in ("first_time", "last_time", "duration", "throughput_mbps") else c for c in found.columns])


def interval_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per hour and direction."""
    found = capture.intervals(packets(spark, sf_dir), INTERVAL).drop("rtt_histogram")
    return found.withColumn("throughput_mbps", F.round("throughput_mbps", 9)).withColumn("interval_start", F.col("interval_start").cast("double"))


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of seen, TCP, analysed, timed and untimed packets of the upload direction."""
    return capture.coverage(packets(spark, sf_dir), "upload").withColumn("analysed_seconds", F.round("analysed_seconds", 6))


def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the large packets, with the counts of all packets in place of its own."""
    rows = packets(spark, sf_dir)
    merged = capture.merge_coverage(capture.coverage(rows.where("n_bytes >= 5000"), "upload"), capture.coverage(rows))
    return merged.select("packets_seen", "tcp_packets_seen", "packets_analysed", "analysed_bytes")


def rtt_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(direction, upper bound, count) over the fixed bounds."""
    rows = packets(spark, sf_dir).groupBy("direction").agg(fields.histogram(F.col("rtt_ms")).alias("h"))
    return rows.select("direction", F.inline("h"))


def histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound that reaches 95 %, and the mean bound, of each flow's histogram."""
    flows = capture.flows(packets(spark, sf_dir))
    return flows.select(
        "flow_id", rules.histogram_p95(F.col("rtt_histogram")).alias("p95_bound"), F.round(rules.histogram_mean(F.col("rtt_histogram")), 6).alias("mean_bound")
    )


def capture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packet and anomaly type."""
    found = capture.events(packets(spark, sf_dir))
    return found.withColumn("time_relative", F.round("time_relative", 6)).withColumn("ack_rtt", F.round("ack_rtt", 6))


def label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one event label of each marked packet."""
    return packets(spark, sf_dir).select("frame", capture.event_label().alias("label")).where("label is not null")


def syn_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the options of SYN packets."""
    return capture.syn_options(packets(spark, sf_dir))


def timebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least of the directions' first epochs."""
    return capture.timebase(packets(spark, sf_dir)).select(F.round(F.col("timebase_epoch").cast("double"), 6).alias("timebase_epoch"))


_PAGE = evidence.EvidenceQuery(
    predicates=[evidence.Predicate("tcp.len", "gte", 200), evidence.Predicate("direction", "ne", "download"), evidence.Predicate("frame.time_relative", "exists", True)],
    types=["window_changes", "out_of_order_segments"], start=3600.0, end=2_000_000.0, offset=20, limit=100,
)


def _plain(rows: DataFrame) -> DataFrame:
    named = rows.toDF(*[c.replace(".", "_") for c in rows.columns])
    return named.withColumn("frame_time_relative", F.round("frame_time_relative", 6)).withColumn("tcp_analysis_ack_rtt", F.round("tcp_analysis_ack_rtt", 6))


def evidence_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of anomaly events by predicates, types and time."""
    return _plain(evidence.page(capture.events(packets(spark, sf_dir)), _PAGE)[0])


def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of that page: total, next offset, truncated."""
    return evidence.page(capture.events(packets(spark, sf_dir)), _PAGE)[1]


def lower_bound_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of that page without counting further than one row past it."""
    return evidence.lower_bound_page(capture.events(packets(spark, sf_dir)), _PAGE)[1]


def sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of flows by bytes."""
    flows = capture.flows(packets(spark, sf_dir)).select("flow_id", "n_bytes", "n_packets", "retransmission_count")
    return evidence.sorted_page(flows, ("n_bytes", "n_packets"), "n_bytes", True, "flow_id", 10, 25)


def flow_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as flows: mostly one return flag, at least 50 pieces; opened by the first open line."""
    lines = table(spark, sf_dir, "lineitem").withColumn("place", F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey"))
    return capture.classify(lines, "l_orderkey", "l_returnflag", "l_quantity", "place", F.col("l_linestatus") == "O", 50, 0.6)


_EVENTS = f"""{PACKETS},
    ev AS (SELECT frame || ':' || t.event_type || ':' || direction || ':' || flow_id AS evidence_id, t.event_type, frame AS frame_number,
                  time AS time_relative, flow_id, direction, tcp_seq, tcp_ack, window_size AS tcp_window_size, n_bytes AS tcp_len, rtt_ms / 1000.0 AS ack_rtt
           FROM p, LATERAL (SELECT unnest([CASE WHEN retransmission THEN 'retransmission' END,
             CASE WHEN fast_retransmission THEN 'fast_retransmission' END, CASE WHEN duplicate_ack THEN 'duplicate_ack' END,
             CASE WHEN out_of_order THEN 'out_of_order' END, CASE WHEN zero_window THEN 'zero_window' END,
             CASE WHEN window_full THEN 'window_full' END]) AS event_type) t
           WHERE is_tcp AND frame > 0 AND t.event_type IS NOT NULL),
    hit AS (SELECT * FROM ev WHERE tcp_len >= 200 AND direction <> 'download' AND time_relative BETWEEN 3600 AND 2000000
              AND event_type IN ('zero_window', 'window_full', 'out_of_order'))"""
_BOUNDS = "[1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 'inf'::DOUBLE]"
_NAMES = "['1', '5', '10', '20', '50', '100', '200', '500', '1000', 'inf']"

QUERIES = {
    f.__name__: f
    for f in (
        capture_summary, flow_metrics, interval_packets, coverage_summary, coverage_merge, rtt_histogram, histogram_quantiles, capture_events,
        label_precedence, syn_options, timebase, evidence_page, page_total, lower_bound_page, sorted_page, flow_classification,
    )
}

ORACLE_SQL = {
    "capture_summary": f"""WITH {PACKETS} SELECT {_METRICS}, CAST(coalesce(sum(n_bytes) FILTER (direction = 'download'), 0) AS BIGINT) AS download_bytes,
        CAST(coalesce(sum(n_bytes) FILTER (direction = 'upload'), 0) AS BIGINT) AS upload_bytes FROM p WHERE is_tcp""",
    "flow_metrics": f"""WITH {PACKETS}, f AS (SELECT flow_id, {_METRICS},
          CASE WHEN min(direction) = max(direction) THEN min(direction) ELSE 'both' END AS direction, min(time) AS first_time, max(time) AS last_time
          FROM p WHERE is_tcp GROUP BY flow_id),
        g AS (SELECT *, coalesce(last_time - first_time, 0.0) AS d FROM f)
        SELECT * EXCLUDE (d, first_time, last_time), round(first_time, 6) AS first_time, round(last_time, 6) AS last_time, round(d, 6) AS duration,
               round(CASE WHEN d > 0 THEN n_bytes * 8.0::DOUBLE / (d * 1e6) ELSE 0.0 END, 6) AS throughput_mbps FROM g""",
    "interval_packets": f"""WITH {PACKETS}, i AS (SELECT floor(time / 3600.0) * 3600.0::DOUBLE AS interval_start, direction, {_METRICS}
          FROM p WHERE is_tcp AND time IS NOT NULL GROUP BY 1, 2)
        SELECT *, round(n_bytes * 8.0::DOUBLE / (3600.0 * 1e6), 9) AS throughput_mbps FROM i""",
    "coverage_summary": f"""WITH {PACKETS}, q AS (SELECT *, is_tcp AND direction = 'upload' AS a FROM p)
        SELECT count(*) AS packets_seen, count(*) FILTER (is_tcp) AS tcp_packets_seen, count(*) FILTER (a) AS packets_analysed,
               CAST(coalesce(sum(n_bytes) FILTER (a), 0) AS BIGINT) AS analysed_bytes,
               round(coalesce(max(time) FILTER (a) - min(time) FILTER (a), 0.0), 6) AS analysed_seconds,
               count(*) FILTER (a AND time IS NOT NULL) AS timed, count(*) FILTER (a AND time IS NULL) AS untimed,
               count(*) FILTER (time < 0) AS negative_times FROM q""",
    "coverage_merge": f"""WITH {PACKETS} SELECT count(*) AS packets_seen, count(*) FILTER (is_tcp) AS tcp_packets_seen,
        count(*) FILTER (is_tcp AND direction = 'upload' AND n_bytes >= 5000) AS packets_analysed,
        CAST(coalesce(sum(n_bytes) FILTER (is_tcp AND direction = 'upload' AND n_bytes >= 5000), 0) AS BIGINT) AS analysed_bytes FROM p""",
    "rtt_histogram": f"""WITH {PACKETS}, b AS (SELECT unnest({_BOUNDS}) AS hi, unnest({_NAMES}) AS upper_bound_ms, generate_subscripts({_NAMES}, 1) AS n)
        SELECT d.direction, b.upper_bound_ms, count(p.frame) AS count
        FROM (SELECT DISTINCT direction FROM p) d CROSS JOIN b
        LEFT JOIN p ON p.direction = d.direction AND p.rtt_ms >= 0 AND p.rtt_ms <= b.hi AND (b.n = 1 OR p.rtt_ms > {_BOUNDS}[b.n - 1]) GROUP BY 1, 2""",
    "histogram_quantiles": f"""WITH {PACKETS},
        b AS (SELECT unnest({_BOUNDS}) AS hi, generate_subscripts({_NAMES}, 1) AS n),
        c AS (SELECT flow_id, n, CASE WHEN n = 10 THEN 2000.0 ELSE hi END::DOUBLE AS shown, count(*) AS c FROM p JOIN b
              ON p.rtt_ms >= 0 AND p.rtt_ms <= b.hi AND (b.n = 1 OR p.rtt_ms > {_BOUNDS}[b.n - 1]) WHERE is_tcp GROUP BY ALL),
        r AS (SELECT *, sum(c) OVER (PARTITION BY flow_id ORDER BY n) AS run, sum(c) OVER (PARTITION BY flow_id) AS total FROM c)
        SELECT flow_id, min(shown) FILTER (run >= total * 0.95) AS p95_bound, round(sum(c * shown) / sum(c), 6) AS mean_bound FROM r GROUP BY flow_id""",
    "capture_events": f"WITH {_EVENTS} SELECT * REPLACE (round(time_relative, 6) AS time_relative, round(ack_rtt, 6) AS ack_rtt) FROM ev",
    "label_precedence": f"""WITH {PACKETS}, l AS (SELECT frame, CASE WHEN fast_retransmission THEN 'fast_retransmission' WHEN retransmission THEN 'retransmission'
          WHEN duplicate_ack THEN 'duplicate_ack' WHEN out_of_order THEN 'out_of_order' WHEN zero_window THEN 'zero_window'
          WHEN window_full THEN 'window_full' END AS label FROM p) SELECT * FROM l WHERE label IS NOT NULL""",
    "syn_options": f"""WITH {PACKETS}, s AS (SELECT * FROM p WHERE is_tcp AND syn)
        SELECT 'syn' AS option, '1' AS value, count(*) AS n FROM s UNION ALL SELECT 'mss', CAST(mss AS VARCHAR), count(*) FROM s GROUP BY mss
        UNION ALL SELECT 'window_scale', CAST(wscale AS VARCHAR), count(*) FROM s GROUP BY wscale
        UNION ALL SELECT 'sack_permitted', '1', count(*) FROM s WHERE sack""",
    "timebase": f"WITH {PACKETS}, f AS (SELECT direction, arg_min(epoch, frame) AS epoch FROM p GROUP BY 1) SELECT round(min(epoch), 6) AS timebase_epoch FROM f",
    "evidence_page": f"""WITH {_EVENTS} SELECT evidence_id, event_type, frame_number, round(time_relative, 6) AS frame_time_relative, flow_id, direction,
        tcp_seq, tcp_ack, tcp_window_size, tcp_len, round(ack_rtt, 6) AS tcp_analysis_ack_rtt
        FROM hit ORDER BY time_relative, frame_number, evidence_id LIMIT 100 OFFSET 20""",
    "page_total": f"WITH {_EVENTS} SELECT count(*) AS total, CASE WHEN count(*) > 120 THEN 120 END AS next_offset, count(*) > 120 AS truncated FROM hit",
    "lower_bound_page": f"""WITH {_EVENTS} SELECT least(count(*), 120) AS total, count(*) <= 120 AS total_exact,
        CASE WHEN count(*) > 120 THEN 120 END AS next_offset FROM hit""",
    "sorted_page": f"""WITH {PACKETS} SELECT flow_id, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, count(*) AS n_packets,
        count(*) FILTER (retransmission OR fast_retransmission) AS retransmission_count
        FROM p WHERE is_tcp GROUP BY flow_id ORDER BY n_bytes DESC, flow_id LIMIT 25 OFFSET 10""",
    "flow_classification": """WITH l AS (SELECT *, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS place FROM lineitem),
        f AS (SELECT l_orderkey, arg_min(l_returnflag, place) AS first_side, arg_min(l_returnflag, place) FILTER (l_linestatus = 'O') AS client_side
              FROM l GROUP BY 1),
        s AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS b FROM l GROUP BY 1, 2),
        t AS (SELECT f.*, sum(b) AS total_bytes, max(b) AS largest, sum(CASE WHEN l_returnflag = first_side THEN b ELSE 0 END) AS slot0_bytes,
                     sum(CASE WHEN l_returnflag <> first_side THEN b ELSE 0 END) AS slot1_bytes,
                     sum(CASE WHEN l_returnflag = client_side THEN b ELSE 0 END) AS client_bytes
              FROM s JOIN f USING (l_orderkey) GROUP BY ALL)
        SELECT l_orderkey, first_side, client_side, total_bytes, slot0_bytes, slot1_bytes, round(largest / total_bytes, 6) AS max_direction_ratio,
               CASE WHEN client_side IS NULL THEN 'unknown' WHEN client_bytes > total_bytes - client_bytes THEN 'upload' ELSE 'download' END AS category
        FROM t WHERE total_bytes >= 50 AND largest / total_bytes >= 0.6""",
}
