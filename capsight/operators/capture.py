"""Packet rows to flows, intervals, histograms, coverage and anomaly events.

Packet rows are text fields of one TCP packet each (``PACKET_SCHEMA``; ``direction`` is upload or
download, ``seq`` the order of arrival). ``typed`` parses them once; every aggregate works on that.
All aggregates are sums, counts, minima and maxima, so a flow with any share of the packets is
combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsight.functions import fields, network

#: Event types and the fields that mark them, in order.
EVENT_FIELDS = (
    ("retransmission", "tcp.analysis.retransmission"),
    ("fast_retransmission", "tcp.analysis.fast_retransmission"),
    ("duplicate_ack", "tcp.analysis.duplicate_ack"),
    ("out_of_order", "tcp.analysis.out_of_order"),
    ("zero_window", "tcp.analysis.zero_window"),
    ("window_full", "tcp.analysis.window_full"),
)
PACKET_FIELDS = (
    "frame.number", "frame.time_epoch", "frame.time_relative", "ip.src", "ip.dst", "ipv6.src", "ipv6.dst",
    "tcp.srcport", "tcp.dstport", "tcp.seq", "tcp.ack", "tcp.len", "tcp.window_size", "tcp.window_size_value",
    "tcp.flags.syn", "tcp.flags.ack", "tcp.options.mss_val", "tcp.options.wscale.shift", "tcp.options.sack_perm",
    "tcp.analysis.ack_rtt", *(field for _, field in EVENT_FIELDS),
)
PACKET_SCHEMA = T.StructType([T.StructField("direction", T.StringType()), *(T.StructField(f, T.StringType()) for f in PACKET_FIELDS)])


def _f(name: str) -> Column:
    return F.col(f"`{name}`")


def typed(packets: DataFrame, with_ipv6: bool = False) -> DataFrame:
    """Parsed packets: direction, frame, time, rtt_ms, n_bytes, window, flow_id, markers, SYN options.

    A packet without both ports is no TCP packet (``is_tcp`` false). Blank and malformed optional
    numbers are null; a malformed tcp.len fails the job. A ``flow_id`` that the rows have is taken as it is.
    """
    src, dst = fields.first_filled(_f("ip.src"), _f("ipv6.src")), fields.first_filled(_f("ip.dst"), _f("ipv6.dst"))
    sport, dport = fields.blank_to_null(_f("tcp.srcport")), fields.blank_to_null(_f("tcp.dstport"))
    marks = [fields.is_marked(_f(field)).alias(name) for name, field in EVENT_FIELDS]
    return packets.select(
        "direction",
        fields.lenient_long(_f("frame.number")).alias("frame"),
        fields.blank_to_null(_f("frame.time_epoch")).try_cast("decimal(20,9)").alias("epoch"),
        fields.finite_double(_f("frame.time_relative")).alias("time"),
        (fields.finite_double(_f("tcp.analysis.ack_rtt")) * 1000.0).alias("rtt_ms"),
        F.coalesce(fields.strict_long(fields.blank_to_null(_f("tcp.len"))), F.lit(0)).alias("n_bytes"),
        fields.lenient_long(fields.first_filled(_f("tcp.window_size"), _f("tcp.window_size_value"))).alias("window"),
        fields.lenient_long(_f("tcp.seq")).alias("tcp_seq"), fields.lenient_long(_f("tcp.ack")).alias("tcp_ack"),
        (sport.isNotNull() & dport.isNotNull()).alias("is_tcp"),
        F.col("flow_id") if "flow_id" in packets.columns else network.flow_id(src, sport, dst, dport, with_ipv6).alias("flow_id"),
        F.concat_ws(":", src, sport).alias("from_end"),
        fields.is_marked(_f("tcp.flags.syn")).alias("syn"), fields.is_marked(_f("tcp.flags.ack")).alias("ack"),
        fields.blank_to_null(_f("tcp.options.mss_val")).alias("mss"),
        fields.blank_to_null(_f("tcp.options.wscale.shift")).alias("wscale"),
        fields.is_marked(_f("tcp.options.sack_perm")).alias("sack"),
        *marks,
    )


def metrics(n_bytes: str = "n_bytes", window: str = "window") -> list[Column]:
    """Aggregates of one group of packets. A fast retransmission counts as a retransmission, once."""
    return [
        F.count("*").alias("n_packets"),
        F.coalesce(F.sum(n_bytes), F.lit(0)).alias("n_bytes"),
        F.min(window).alias("window_min"),
        F.max(window).alias("window_max"),
        F.count_if(F.col("retransmission") | F.col("fast_retransmission")).alias("retransmission_count"),
        *[F.count_if(F.col(name)).alias(f"{name}_count") for name, _ in EVENT_FIELDS[2:]],
    ]


def summary(packets: DataFrame, target: str | None = None) -> DataFrame:
    """One row over all TCP packets (of the ``target`` direction): metrics, bytes by direction, histogram."""
    chosen = _chosen(packets, target)
    return chosen.agg(
        *metrics(),
        *[F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("n_bytes"))), F.lit(0)).alias(f"{d}_bytes") for d in ("download", "upload")],
        fields.histogram(F.col("rtt_ms")).alias("rtt_histogram"),
    )


def _chosen(packets: DataFrame, target: str | None) -> DataFrame:
    chosen = packets.where("is_tcp")
    return chosen if target is None else chosen.where(F.col("direction") == target)


def flows(packets: DataFrame, target: str | None = None) -> DataFrame:
    """One row per flow: metrics, direction (both if it has two), first and last time, duration, throughput, histogram."""
    duration = F.coalesce(F.col("last_time") - F.col("first_time"), F.lit(0.0))
    return (
        _chosen(packets, target).groupBy("flow_id")
        .agg(
            *metrics(),
            F.when(F.min("direction") == F.max("direction"), F.min("direction")).otherwise("both").alias("direction"),
            F.min("time").alias("first_time"), F.max("time").alias("last_time"),
            fields.histogram(F.col("rtt_ms")).alias("rtt_histogram"),
        )
        .withColumn("duration", duration)
        .withColumn("throughput_mbps", fields.megabits_per_second(F.col("n_bytes"), F.col("duration")))
    )


def intervals(packets: DataFrame, seconds: float, target: str | None = None) -> DataFrame:
    """One row per interval with packets and direction; packets without time belong to none."""
    return (
        _chosen(packets, target).where("time is not null")
        .groupBy(fields.interval_start(F.col("time"), seconds).alias("interval_start"), "direction")
        .agg(*metrics(), fields.histogram(F.col("rtt_ms")).alias("rtt_histogram"))
        .withColumn("throughput_mbps", fields.megabits_per_second(F.col("n_bytes"), F.lit(float(seconds))))
    )


def coverage(packets: DataFrame, target: str | None = None) -> DataFrame:
    """One row: packets seen, TCP packets, analysed ones (of the target direction), bytes, duration, with and without time."""
    analysed = F.col("is_tcp") if target is None else F.col("is_tcp") & (F.col("direction") == target)
    return packets.agg(
        F.count("*").alias("packets_seen"), F.count_if("is_tcp").alias("tcp_packets_seen"), F.count_if(analysed).alias("packets_analysed"),
        F.coalesce(F.sum(F.when(analysed, F.col("n_bytes"))), F.lit(0)).alias("analysed_bytes"),
        F.coalesce(F.max(F.when(analysed, F.col("time"))) - F.min(F.when(analysed, F.col("time"))), F.lit(0.0)).alias("analysed_seconds"),
        F.count_if(analysed & F.col("time").isNotNull()).alias("timed"), F.count_if(analysed & F.col("time").isNull()).alias("untimed"),
        F.count_if(F.col("time") < 0).alias("negative_times"),
    )


def events(packets: DataFrame) -> DataFrame:
    """One row per marked packet and event type, with an id unique per frame, type, direction and flow."""
    kinds = F.array_compact(F.array(*[F.when(F.col(name), name) for name, _ in EVENT_FIELDS]))
    return (
        packets.where("is_tcp and frame > 0").withColumn("event_type", F.explode(kinds))
        .select(
            F.concat_ws(":", "frame", "event_type", "direction", "flow_id").alias("evidence_id"), "event_type",
            F.col("frame").alias("frame_number"), F.col("time").alias("time_relative"), "flow_id", "direction",
            "tcp_seq", "tcp_ack", F.col("window").alias("tcp_window_size"), F.col("n_bytes").alias("tcp_len"),
            (F.col("rtt_ms") / 1000.0).alias("ack_rtt"),
        )
    )


def event_label(precedence: tuple[str, ...] = ("fast_retransmission", "retransmission", "duplicate_ack", "out_of_order", "zero_window", "window_full")) -> Column:
    """The one event type of a packet that has several: the first in precedence."""
    return F.coalesce(*[F.when(F.col(name), name) for name in precedence])


def syn_options(packets: DataFrame) -> DataFrame:
    """(option, value, n): counts of MSS and window-scale texts and of SACK permissions, over packets with SYN."""
    syn = packets.where("is_tcp and syn")
    option = lambda name, value: F.struct(F.lit(name).alias("option"), value.alias("value"))
    return (
        syn.select(F.inline(F.array(
            option("syn", F.lit("1")), option("mss", F.col("mss")), option("window_scale", F.col("wscale")), option("sack_permitted", F.when(F.col("sack"), "1")),
        )))
        .where("value is not null").groupBy("option", "value").agg(F.count("*").alias("n"))
    )


def timebase(packets: DataFrame) -> DataFrame:
    """One row: the least of the directions' first timed epochs, in order of frames."""
    first = packets.where("epoch is not null").groupBy("direction").agg(F.min_by("epoch", "frame").alias("epoch"))
    return first.agg(F.min("epoch").alias("timebase_epoch"))


def relative_to(packets: DataFrame, base: DataFrame) -> DataFrame:
    """Packets with ``time`` counted from the timebase; decimals are subtracted before they become doubles."""
    return packets.crossJoin(F.broadcast(base)).withColumn("time", (F.col("epoch") - F.col("timebase_epoch")).cast("double")).drop("timebase_epoch")


def classify(rows: DataFrame, key: str, side: str, size: str, order: str, opens: Column, min_bytes: float, min_ratio: float) -> DataFrame:
    """Flows with enough bytes, mostly one way, as upload or download.

    ``side`` tells a flow's two directions apart; slot 0 is the direction seen first by ``order``. The
    client is the direction of the first row where ``opens`` holds. Upload if the client's bytes are
    strictly more than the other's; unknown without an opening row.
    """
    first = rows.groupBy(key).agg(
        F.min_by(side, order).alias("first_side"),
        F.min_by(F.when(opens, F.col(side)), F.when(opens, F.col(order))).alias("client_side"),
    )
    sides = rows.groupBy(key, side).agg(F.sum(size).alias("side_bytes"))
    totals = sides.join(first, key).groupBy(key, "first_side", "client_side").agg(
        F.sum("side_bytes").alias("total_bytes"), F.max("side_bytes").alias("largest"),
        F.coalesce(F.sum(F.when(F.col(side) == F.col("first_side"), F.col("side_bytes"))), F.lit(0)).alias("slot0_bytes"),
        F.coalesce(F.sum(F.when(F.col(side) != F.col("first_side"), F.col("side_bytes"))), F.lit(0)).alias("slot1_bytes"),
        F.coalesce(F.sum(F.when(F.col(side) == F.col("client_side"), F.col("side_bytes"))), F.lit(0)).alias("client_bytes"),
    )
    ratio = F.when(F.col("total_bytes") > 0, F.col("largest") / F.col("total_bytes")).otherwise(0.0)
    return totals.withColumn("max_direction_ratio", F.round(ratio, 6)).where((F.col("total_bytes") >= min_bytes) & (ratio >= min_ratio)).select(
        key, "first_side", "client_side", "total_bytes", "slot0_bytes", "slot1_bytes", "max_direction_ratio",
        F.when(F.col("client_side").isNull(), "unknown")
        .when(F.col("client_bytes") > F.col("total_bytes") - F.col("client_bytes"), "upload").otherwise("download").alias("category"),
    )


def merge_coverage(analysed: DataFrame, seen: DataFrame) -> DataFrame:
    """Coverage with the counts of the filter stage in place of those after it."""
    names = ["packets_seen", "tcp_packets_seen"]
    return analysed.drop(*names).crossJoin(F.broadcast(seen.select(*names)))
