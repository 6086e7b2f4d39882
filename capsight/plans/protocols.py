"""Multi-protocol queries over ``events``, ``orders``, ``lineitem``, ``pages`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.functions import fields
from capsight.operators import protocols, rules
from capsight.plans.packets import k_of, seconds_since_first
from capsight.plans.tables import table

WORDS = ("timeout", "error", "token", "license", "the", "Copyright")


def endpoint_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers as endpoints of order lines."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"),
        F.col("l_quantity").cast("long").alias("n_bytes"), F.col("l_returnflag").alias("protocol"), (F.col("l_linestatus") == "O").alias("syn"),
        (F.col("l_linenumber") == 1).alias("ack"), (F.col("l_discount") > 0.08).alias("reset"), (F.col("l_tax") > 0.06).alias("retransmission"),
    )
    return protocols.endpoints(rows).withColumn("protocols", F.array_join("protocols", ","))


def top_k_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred parts with most order lines."""
    return protocols.top_k(table(spark, sf_dir, "lineitem"), ["l_partkey"], 100)


def _dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, client = k_of(), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    reply = F.col("event_type").isin("purchase", "error")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), reply.alias("is_response"), k.alias("id"), F.when(reply, "server").otherwise(client).alias("src"),
        F.when(reply, client).otherwise("server").alias("dst"), F.concat(F.lit("Host"), (F.col("user_id") % 7).cast("string"), F.lit(".example.com.")).alias("name"),
        F.when(F.col("event_type") == "error", 3).otherwise(0).alias("rcode"),
        F.when(reply, F.array(F.concat(F.lit("10.0.0."), (k % 4).cast("string")))).otherwise(F.array().cast("array<string>")).alias("answers"),
    )


_DNS = """d AS (SELECT event_id AS seq, event_type IN ('purchase', 'error') AS r, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS id,
    'u' || user_id AS client, 'Host' || (user_id % 7) || '.example.com.' AS name, event_type = 'error' AS bad FROM events)"""


def tiered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reply with the tier of its best earlier question."""
    return protocols.dns_pairs(_dns(spark, sf_dir))


def dns_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, replies, failures and unanswered questions."""
    return protocols.dns_totals(_dns(spark, sf_dir))


def domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, answers and family per host name."""
    return protocols.domains(_dns(spark, sf_dir)).withColumn("answers", F.array_join("answers", ","))


def endpoint_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with the hosts that they answer for, those without packets included."""
    seen = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("10.0.0."), (k_of() % 6).cast("string")).alias("ip")).agg(F.count("*").alias("packets"))
    return protocols.endpoint_domains(protocols.domains(_dns(spark, sf_dir)), seen).withColumn("domains", F.array_join("domains", ","))


def _tls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = k_of()
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("stream"),
        F.when(F.col("event_type") == "click", "1").when(F.col("event_type") == "view", "2").when(F.col("event_type") == "signup", "1, 11").otherwise("").alias("handshake_types"),
        F.when(k % 5 == 0, F.concat(F.lit(" WWW.Site"), (k % 3).cast("string"), F.lit(".co.uk."))).otherwise("").alias("sni"),
        F.when(F.col("event_type") == "error", "40").otherwise("").alias("alert"), F.concat(F.lit("10.0.0."), (k % 4).cast("string")).alias("dst"),
    )


_TLS = """t AS (SELECT event_id AS seq, user_id AS stream, event_type AS kind, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
    a AS (SELECT *, last_value(CASE WHEN k % 5 = 0 THEN 'www.site' || (k % 3) || '.co.uk' END IGNORE NULLS)
             OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS server FROM t),
    s AS (SELECT server, count(*) FILTER (kind IN ('click', 'signup')) AS client_hellos, count(*) FILTER (kind = 'view') AS server_hellos,
             count(*) FILTER (kind = 'error') AS alerts,
             coalesce(array_to_string(list_sort(list_distinct(list('10.0.0.' || (k % 4)) FILTER (kind IN ('click', 'signup')))), ','), '') AS ips
          FROM a WHERE server IS NOT NULL GROUP BY 1)"""


def tls_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hellos and alerts per server name as of each stream's latest hello."""
    return protocols.tls_servers(_tls(spark, sf_dir)).withColumn("ips", F.array_join("ips", ","))


def http_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, responses and errors."""
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "click", "GET").otherwise("").alias("method"), F.when(F.col("event_type") != "click", k_of() * 6).alias("status")
    )
    return protocols.http_totals(rows)


def udp_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets, bytes, gaps per UDP flow."""
    rows = seconds_since_first(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("seq"), "time", F.round(F.col("value") * 100).cast("long").alias("n_bytes"),
        F.when(F.col("event_type") == "view", "QUIC").otherwise("UDP").alias("protocol"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 9).cast("string")).alias("src"), (F.col("user_id") % 5).alias("sport"),
        F.concat(F.lit("10.0.0."), (k_of() % 9).cast("string")).alias("dst"), F.lit(53).alias("dport"),
    )
    return protocols.udp_flows(rows).withColumn("max_gap", F.round("max_gap", 6))


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, nearest-rank 95th percentile and maximum per event type."""
    return protocols.latency(table(spark, sf_dir, "events"), "value", "event_type")


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each word."""
    return protocols.keyword_hits(table(spark, sf_dir, "documents"), "text", WORDS)


def ranked_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain families by score."""
    return protocols.family_scores(protocols.domains(_dns(spark, sf_dir)), protocols.tls_servers(_tls(spark, sf_dir)))


def domain_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per family of their host."""
    host = fields.hostname(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return table(spark, sf_dir, "pages").withColumn("family", fields.domain_family(host)).groupBy("family").agg(F.count("*").alias("n_pages"))


def host_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the hosts at or under example.com."""
    host = fields.hostname(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host")).where(fields.host_matches(F.col("host"), F.lit("example.com")))


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fired rules and ranks, users as captures."""
    kind = F.col("event_type")
    facts = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("packets"), F.count_if((kind == "error") & (k_of() < 5)).alias("retransmissions"), F.count_if((kind == "purchase") & (k_of() < 3)).alias("zero_windows"),
        F.max("value").alias("rtt_p95_ms"), F.count_if((kind == "error") & (k_of() == 7)).alias("dns_failures"), F.count_if((kind == "view") & (k_of() == 9)).alias("http_errors"),
    )
    found = rules.ranked(rules.diagnose(facts, "user_id"), "user_id")
    return found.select("user_id", "rule", "rank", F.round("confidence", 6).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        endpoint_rollup, top_k_groups, tiered_match, dns_totals, domain_rollup, endpoint_domains, tls_servers, http_totals, udp_flows, latency_summary,
        keyword_hits, ranked_families, domain_family, host_suffix_match, diagnoses,
    )
}

_HOST = r"rtrim(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '.')"
_FAMILY = """CASE WHEN len(l) <= 2 THEN host WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ('com', 'net', 'org', 'co')
    THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END"""
_DOMAINS = """h AS (SELECT rtrim(lower(name), '.') AS host, count(*) FILTER (NOT r) AS queries, count(*) FILTER (r) AS responses,
    count(*) FILTER (r AND bad) AS failures,
    coalesce(array_to_string(list_sort(list_distinct(list('10.0.0.' || (id % 4)) FILTER (r))), ','), '') AS answers FROM d GROUP BY 1)"""

ORACLE_SQL = {
    "endpoint_rollup": """WITH x AS (SELECT 's' || l_suppkey AS src, 'c' || o_custkey AS dst, CAST(l_quantity AS BIGINT) AS b, l_returnflag AS f, l_linestatus = 'O' AS syn,
          l_linenumber = 1 AS ack, l_discount > 0.08 AS rst, l_tax > 0.06 AS re FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        u AS (SELECT src AS ip, b AS sent, 0 AS received, 0 AS syn, CAST(syn AND ack AS INT) AS sa, CAST(rst AS INT) AS rst, CAST(re AS INT) AS re, f FROM x
              UNION ALL SELECT dst, 0, b, CAST(syn AND NOT ack AS INT), 0, 0, 0, f FROM x)
        SELECT ip, count(*) AS packets, CAST(sum(sent) AS BIGINT) AS sent_bytes, CAST(sum(received) AS BIGINT) AS received_bytes, CAST(sum(syn) AS BIGINT) AS syn,
               CAST(sum(sa) AS BIGINT) AS syn_ack, CAST(sum(rst) AS BIGINT) AS resets, CAST(sum(re) AS BIGINT) AS retransmissions,
               array_to_string(list_sort(list_distinct(list(f))), ',') AS protocols FROM u GROUP BY ip""",
    "top_k_groups": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "tiered_match": f"""WITH {_DNS}, q AS (SELECT id, client, name, min(seq) AS seq FROM d WHERE NOT r GROUP BY 1, 2, 3)
        SELECT a.seq, a.id, 'server' AS src, a.client AS dst, a.name,
               min(CASE WHEN q.id IS NULL THEN NULL WHEN q.client = a.client AND q.name = a.name THEN 1 WHEN q.client = a.client THEN 2 ELSE 3 END) AS tier
        FROM d a LEFT JOIN q ON q.id = a.id AND q.seq < a.seq WHERE a.r GROUP BY ALL""",
    "dns_totals": f"""WITH {_DNS}, q AS (SELECT DISTINCT id, client, name FROM d WHERE NOT r), s AS (SELECT DISTINCT id, client, name FROM d WHERE r)
        SELECT count(*) FILTER (r) AS responses, count(*) FILTER (r AND bad) AS failures, (SELECT count(*) FROM q) AS queries,
               (SELECT count(*) FROM q ANTI JOIN s USING (id, client, name)) AS unanswered FROM d""",
    "domain_rollup": f"""WITH {_DNS}, {_DOMAINS} SELECT h.*, greatest(queries - responses, 0) AS unanswered, 'example.com' AS family FROM h""",
    "endpoint_domains": f"""WITH {_DNS}, n AS (SELECT '10.0.0.' || (id % 4) AS ip, array_to_string(list_sort(list_distinct(list(rtrim(lower(name), '.')))), ',') AS domains
          FROM d WHERE r GROUP BY 1),
        e AS (SELECT '10.0.0.' || (id % 6) AS ip, count(*) AS packets FROM d GROUP BY 1)
        SELECT ip, coalesce(packets, 0) AS packets, domains FROM e FULL JOIN n USING (ip)""",
    "tls_servers": f"WITH {_TLS} SELECT * FROM s",
    "http_totals": """SELECT count(*) FILTER (event_type = 'click') AS requests, count(*) FILTER (event_type <> 'click') AS responses,
        count(*) FILTER (event_type <> 'click' AND CAST(regexp_extract(props, '[0-9]+') AS BIGINT) * 6 >= 400) AS errors FROM events""",
    "udp_flows": """WITH e AS (SELECT *, '10.0.0.' || (user_id % 9) AS a, CAST(user_id % 5 AS VARCHAR) AS ap,
          '10.0.0.' || (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 9) AS b, '53' AS bp FROM events),
        f AS (SELECT *, CASE WHEN a < b OR (a = b AND ap <= bp) THEN a || ':' || ap || '<->' || b || ':' || bp ELSE b || ':' || bp || '<->' || a || ':' || ap END AS flow FROM e),
        g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY flow ORDER BY event_id), 0) / 1e6 AS gap FROM f)
        SELECT flow, count(*) AS packets, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS n_bytes, round(max(gap), 6) AS max_gap,
               count(*) FILTER (gap > 2) AS long_gaps, count(*) FILTER (event_type = 'view') AS quic_packets FROM g GROUP BY flow""",
    "latency_summary": """SELECT event_type, count(*) AS n, round(avg(value), 6) AS average, quantile_disc(value, 0.95) AS p95, max(value) AS max
        FROM events WHERE value IS NOT NULL GROUP BY 1""",
    "keyword_hits": " UNION ALL ".join(f"SELECT '{w}' AS keyword, least(count(*), {protocols.MOST_HITS}) AS hits FROM documents WHERE contains(text, '{w}')" for w in WORDS),
    "ranked_families": f"""WITH {_DNS}, {_DOMAINS}, {_TLS},
        u AS (SELECT 'example.com' AS family, failures * 5 + greatest(queries - responses, 0) * 4 AS score FROM h
              UNION ALL SELECT array_to_string(string_split(server, '.')[-3:], '.'), greatest(client_hellos - server_hellos, 0) * 4 + alerts * 6 FROM s)
        SELECT family, CAST(sum(score) AS BIGINT) AS score FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 32""",
    "domain_family": f"""WITH p AS (SELECT {_HOST} AS x FROM pages), q AS (SELECT CASE WHEN regexp_full_match(x, '[a-z0-9._-]+') THEN x ELSE '' END AS host FROM p),
        r AS (SELECT host, string_split(host, '.') AS l FROM q) SELECT {_FAMILY} AS family, count(*) AS n_pages FROM r GROUP BY 1""",
    "host_suffix_match": f"""WITH p AS (SELECT page_id, {_HOST} AS host FROM pages)
        SELECT * FROM p WHERE regexp_full_match(host, '[a-z0-9._-]+') AND (host = 'example.com' OR ends_with(host, '.example.com'))""",
    "diagnoses": """WITH e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
        f AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error' AND k < 5) AS re, count(*) FILTER (event_type = 'purchase' AND k < 3) AS z,
                     max(value) AS rtt, count(*) FILTER (event_type = 'error' AND k = 7) AS dns, count(*) FILTER (event_type = 'view' AND k = 9) AS http FROM e GROUP BY 1),
        r AS (SELECT user_id, 1 AS o, 'retransmission' AS rule, least(95.0, 55 + re * 1e3 / n) AS c FROM f WHERE re >= 3 OR re / n >= 0.01
              UNION ALL SELECT user_id, 2, 'window_limit', least(92.0, 62 + 3 * z) FROM f WHERE z > 0
              UNION ALL SELECT user_id, 3, 'high_rtt', least(88.0, 55 + rtt / 20) FROM f WHERE rtt >= 300
              UNION ALL SELECT user_id, 6, 'dns_failure', least(94.0, 65 + 4 * dns) FROM f WHERE dns > 0
              UNION ALL SELECT user_id, 9, 'http_error', least(94.0, 68 + 3 * http) FROM f WHERE http > 0)
        SELECT user_id, rule, CAST(row_number() OVER (PARTITION BY user_id ORDER BY c DESC, o) AS INT) AS rank, round(c::DOUBLE, 6) AS confidence FROM r""",
}
