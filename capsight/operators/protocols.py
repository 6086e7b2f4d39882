"""Multi-protocol rollups: protocols, endpoints, DNS, TLS, HTTP, UDP and keyword hits.

Rows come typed: seq (order of arrival), time, n_bytes, protocol, src, dst, sport, dport, and per
protocol the columns that each function names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsight.functions import fields, network
from capsight.operators import series

#: Words looked for in payloads, and the most hits that count.
KEYWORDS = ("timeout", "error", "buffering", "stall", "retry", "unavailable")
MOST_HITS = 10_000
LONG_GAP_SECONDS = 2.0


def top_k(rows: DataFrame, keys: list[str], n: int, first: str | None = None) -> DataFrame:
    """The ``n`` most frequent groups with their counts; ties by first appearance, or by key."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), *([F.min(first).alias("_first")] if first else []))
    out = counted.orderBy(F.col("n").desc(), *(["_first"] if first else []), *keys).limit(n)
    return out.drop("_first")


def endpoints(packets: DataFrame) -> DataFrame:
    """One row per address: packets, sent and received bytes, protocols, SYN (to it), SYN-ACK, resets, retransmissions (by it).

    Blank addresses are an endpoint too. Each packet is two rows, one per side, combined before the shuffle.
    """
    has = lambda name: F.col(name).cast("int")
    side = lambda ip, sent, src: F.struct(
        ip.alias("ip"), F.when(F.lit(sent), F.col("n_bytes")).otherwise(0).alias("sent"), F.when(F.lit(not sent), F.col("n_bytes")).otherwise(0).alias("received"),
        (F.when(F.lit(not src), has("syn") * (1 - has("ack"))).otherwise(0)).alias("syn"),
        (F.when(F.lit(src), has("syn") * has("ack")).otherwise(0)).alias("syn_ack"),
        (F.when(F.lit(src), has("reset")).otherwise(0)).alias("resets"),
        (F.when(F.lit(src), has("retransmission")).otherwise(0)).alias("retransmissions"),
        F.col("protocol"),
    )
    rows = packets.select(F.inline(F.array(side(F.col("src"), True, True), side(F.col("dst"), False, False))))
    return rows.groupBy("ip").agg(
        F.count("*").alias("packets"), F.sum("sent").alias("sent_bytes"), F.sum("received").alias("received_bytes"),
        F.sum("syn").alias("syn"), F.sum("syn_ack").alias("syn_ack"), F.sum("resets").alias("resets"),
        F.sum("retransmissions").alias("retransmissions"), F.array_sort(F.collect_set("protocol")).alias("protocols"),
    )


def dns_pairs(dns: DataFrame) -> DataFrame:
    """Each response with the tier of its query: 1 same id, client and name, 2 same id and client, 3 same id; null unasked.

    ``dns``: seq, is_response, id, src, dst, name. Any earlier query will do, however long ago.
    """
    asked = dns.where(~F.col("is_response")).select("seq", "id", F.col("src").alias("dst"), "name")
    answers = dns.where("is_response").select("seq", "id", "src", "dst", "name")
    return series.tiered_match(answers, asked, "seq", [["id", "dst", "name"], ["id", "dst"], ["id"]], {"name"}, "tier")


def dns_totals(dns: DataFrame) -> DataFrame:
    """One row: distinct queries, responses, failures (rcode not 0), queries without an answer."""
    queries = dns.where(~F.col("is_response")).select("id", F.col("src").alias("client"), "name").distinct()
    answers = dns.where("is_response").select("id", F.col("dst").alias("client"), "name").distinct()
    open_ = queries.join(answers, (queries["id"] == answers["id"]) & (queries["client"] == answers["client"]) & queries["name"].eqNullSafe(answers["name"]), "left_anti")
    return dns.agg(
        F.count_if("is_response").alias("responses"), F.count_if(F.col("is_response") & (F.col("rcode") != 0)).alias("failures"),
    ).crossJoin(queries.agg(F.count("*").alias("queries"))).crossJoin(open_.agg(F.count("*").alias("unanswered")))


def domains(dns: DataFrame) -> DataFrame:
    """One row per host name: queries, responses, failures, unanswered (not below 0), answers and their family."""
    return (
        dns.withColumn("host", fields.hostname(F.col("name"))).where("host <> ''").groupBy("host")
        .agg(
            F.count_if(~F.col("is_response")).alias("queries"), F.count_if("is_response").alias("responses"),
            F.count_if(F.col("is_response") & (F.col("rcode") != 0)).alias("failures"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("answers")))).alias("answers"),
        )
        .withColumn("unanswered", F.greatest(F.col("queries") - F.col("responses"), F.lit(0)))
        .withColumn("family", fields.domain_family(F.col("host")))
    )


def endpoint_domains(domain_rows: DataFrame, endpoint_rows: DataFrame) -> DataFrame:
    """Endpoints with the domains whose answers name them; answers without packets are endpoints of none."""
    named = domain_rows.select(F.explode("answers").alias("ip"), "host").groupBy("ip").agg(F.array_sort(F.collect_set("host")).alias("domains"))
    return endpoint_rows.join(named, "ip", "full_outer").withColumn("packets", F.coalesce("packets", F.lit(0)))


def tls_servers(tls: DataFrame) -> DataFrame:
    """One row per server name, as of each stream's latest hello: client and server hellos, alerts, server addresses.

    ``tls``: seq, stream, handshake_types (comma list), sni, alert, src, dst.
    """
    named = series.as_of(tls, "stream", F.nullif(fields.hostname(F.col("sni")), F.lit("")), "server", "seq")
    client = F.array_contains(fields.comma_list(F.col("handshake_types")), "1")
    server = F.array_contains(fields.comma_list(F.col("handshake_types")), "2")
    return named.where("server is not null").groupBy("server").agg(
        F.count_if(client).alias("client_hellos"), F.count_if(server).alias("server_hellos"),
        F.count_if(fields.is_present(F.col("alert"))).alias("alerts"), F.array_sort(F.collect_set(F.when(client, F.col("dst")))).alias("ips"),
    )


def http_totals(http: DataFrame) -> DataFrame:
    """One row: requests, responses, errors (status 400 and up). ``http``: method, status."""
    return http.agg(
        F.count_if(fields.is_present(F.col("method"))).alias("requests"), F.count_if(F.col("status").isNotNull()).alias("responses"),
        F.count_if(F.col("status") >= 400).alias("errors"),
    )


def udp_flows(udp: DataFrame) -> DataFrame:
    """One row per UDP flow: packets, bytes, longest gap, gaps over two seconds."""
    keyed = udp.withColumn("flow", network.text_flow_key(F.col("src"), F.col("sport"), F.col("dst"), F.col("dport")))
    return series.with_gap(keyed, "flow", "time", "seq").groupBy("flow").agg(
        F.count("*").alias("packets"), F.sum("n_bytes").alias("n_bytes"), F.max("gap").alias("max_gap"),
        F.count_if(F.col("gap") > LONG_GAP_SECONDS).alias("long_gaps"), F.count_if(F.col("protocol") == "QUIC").alias("quic_packets"),
    )


def latency(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean, nearest-rank 95th percentile and maximum, per group."""
    rows = rows.where(F.col(value).isNotNull())
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("average"), F.max(value).alias("max"))
    group = F.struct(F.lit(0).alias("_all"), *keys)
    p95 = series.ranked(rows.select(group.alias("_group"), value), "_group", value, p95=series.rank_of(95))
    return found.join(p95, group.eqNullSafe(F.col("_group"))).select(*keys, "n", "average", "p95", "max")


def keyword_hits(rows: DataFrame, text: str, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """(keyword, hits): rows that hold each word, as written, in one pass."""
    found = rows.agg(*[F.least(F.count_if(F.contains(F.col(text), F.lit(k))), F.lit(MOST_HITS)).alias(k) for k in keywords])
    return found.select(F.inline(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(k).alias("hits")) for k in keywords])))


def family_scores(domain_rows: DataFrame, servers: DataFrame, most: int = 32) -> DataFrame:
    """(family, score): five points per DNS failure, four per unanswered query or missing hello, six per alert."""
    server_family: Column = fields.domain_family(F.col("server"))
    points = domain_rows.select("family", (F.col("failures") * 5 + F.col("unanswered") * 4).alias("score")).union(
        servers.select(server_family, F.greatest(F.col("client_hellos") - F.col("server_hellos"), F.lit(0)) * 4 + F.col("alerts") * 6)
    )
    return points.groupBy("family").agg(F.sum("score").alias("score")).orderBy(F.col("score").desc(), "family").limit(most)
