"""Fixed diagnosis rules over one row of aggregates, their ranking, and stage status.

A rule is a condition and a confidence over the columns of the facts row; all rules are tried in one
projection, so diagnosing any number of captures is one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsight.functions import fields


def _n(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _at_most(limit: float, value: Column) -> Column:
    return F.least(F.lit(float(limit)), value)


def rules() -> list[tuple[str, Column, Column]]:
    """(name, condition, confidence), in order. Thresholds and weights are fixed values."""
    ratio = F.when(_n("packets") > 0, _n("retransmissions") / _n("packets")).otherwise(0.0)
    dns_bad = (_n("dns_failures") > 0) | (_n("dns_unanswered") > 0)
    hello_lead = _n("tls_client_hellos") - _n("tls_server_hellos")
    return [
        ("retransmission", (_n("retransmissions") >= 3) | (ratio >= 0.01), _at_most(95, 55 + ratio * 1000)),
        ("window_limit", (_n("zero_windows") > 0) | (_n("window_fulls") >= 3), _at_most(92, 62 + 3 * _n("zero_windows") + _n("window_fulls"))),
        ("high_rtt", _n("rtt_p95_ms") >= 300, _at_most(88, 55 + _n("rtt_p95_ms") / 20)),
        ("throughput_drop", _n("drops") > 0, _at_most(90, 58 + 4 * _n("drops"))),
        ("data_gap", _n("gaps") > 0, _at_most(86, 52 + 5 * _n("gaps"))),
        ("dns_failure", dns_bad, _at_most(94, 65 + 4 * _n("dns_failures") + 2 * _n("dns_unanswered"))),
        ("dns_slow", ~dns_bad & (_n("dns_p95_ms") >= 500), _at_most(90, 55 + _n("dns_p95_ms") / 25)),
        ("tls_failure", (_n("tls_alerts") > 0) | (hello_lead > 2), _at_most(92, 62 + 5 * _n("tls_alerts") + 2 * F.greatest(hello_lead, F.lit(0.0)))),
        ("http_error", _n("http_errors") > 0, _at_most(94, 68 + 3 * _n("http_errors"))),
        ("http_slow", (_n("http_errors") == 0) & (_n("http_p95_ms") >= 1000), _at_most(92, 58 + _n("http_p95_ms") / 100)),
        ("udp_gap", (_n("udp_long_gap_flows") > 0) & (_n("quic_packets") > 0), _at_most(86, 52 + 4 * _n("udp_long_gap_flows"))),
        ("keyword", _n("keyword_hits") > 0, _at_most(82, 48 + 2 * _n("keyword_hits"))),
    ]


FACTS = (
    "packets", "retransmissions", "zero_windows", "window_fulls", "rtt_p95_ms", "drops", "gaps", "dns_failures", "dns_unanswered",
    "dns_p95_ms", "tls_client_hellos", "tls_server_hellos", "tls_alerts", "http_errors", "http_p95_ms", "udp_long_gap_flows",
    "quic_packets", "keyword_hits",
)


def diagnose(facts: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule, rule_order, confidence 0 to 100) for each rule that fires on each row; absent facts are 0."""
    for name in FACTS:
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(None).cast("double"))
    tried = F.array(
        *[
            F.when(condition, F.struct(F.lit(name).alias("rule"), F.lit(k).alias("rule_order"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), confidence)).alias("confidence")))
            for k, (name, condition, confidence) in enumerate(rules(), 1)
        ]
    )
    return facts.select(*keys, F.inline(F.array_compact(tried)))


def personalised(found: DataFrame, tags: Column, texts: Column, bonus: float = 8.0) -> DataFrame:
    """Confidence raised, to 100 at most, where one of the tags stands in the rule's text."""
    named = F.exists(tags, lambda t: F.contains(F.lower(texts), F.lower(t)))
    return found.withColumn("confidence", F.least(F.lit(100.0), F.col("confidence") + F.when(named, bonus).otherwise(0.0)))


#: Fixed value: the cause of a case that no rule and no business conclusion explains.
NO_CAUSE = "未发现明确的网络层或应用协议卡顿原因"
LEAST_CONFIDENCE = 30.0


def primary(cases: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, cause, confidence, basis) of each case: its first candidate with evidence, else the business conclusion if it
    was aimed at, else its first candidate, else none.

    ``cases``: key, targeted, conclusion. ``found``: key, place (the order of candidates), cause, confidence, n_evidence.
    """
    candidate = F.struct("place", "cause", "confidence")
    firsts = found.groupBy(key).agg(
        F.min(F.when(F.col("n_evidence") > 0, candidate)).alias("_proven"), F.min(candidate).alias("_first")
    )
    out = cases.join(firsts, key, "left")
    proven, aimed = F.col("_proven").isNotNull(), F.coalesce(F.col("targeted"), F.lit(False)) & F.col("conclusion").isNotNull()
    return out.select(
        key, F.when(proven, F.col("_proven.cause")).when(aimed, F.col("conclusion")).otherwise(F.coalesce("_first.cause", F.lit(NO_CAUSE))).alias("cause"),
        F.coalesce("_proven.confidence", "_first.confidence", F.lit(LEAST_CONFIDENCE)).alias("confidence"),
        F.when(proven, "evidence").when(aimed, "business").when(F.col("_first").isNotNull(), "candidate").otherwise("none").alias("basis"),
    )


def ranked(found: DataFrame, *keys: str) -> DataFrame:
    """All rules with their rank by confidence."""
    w = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), "rule_order")
    return found.withColumn("rank", F.row_number().over(w))


def stage_status(kind: str) -> Column:
    """ok, degraded or failed for the dns, transport and tls stages of one target."""
    if kind == "dns":
        return F.when((_n("failures") > 0) | (_n("unanswered") > 0), "failed").otherwise("ok")
    if kind == "transport":
        return (
            F.when((_n("resets") > 0) | (_n("syn") > _n("syn_ack") + 2), "failed").when(_n("retransmissions") > 0, "degraded").otherwise("ok")
        )
    if kind == "tls":
        return F.when((_n("alerts") > 0) | (_n("client_hellos") > _n("server_hellos") + 1), "failed").otherwise("ok")
    raise ValueError(f"unknown stage {kind!r}")


def stage_confidence(status: Column, ambiguous: Column) -> Column:
    """96 for a failed stage, 84 for a degraded one; null for others and ambiguous targets."""
    return F.when(~ambiguous, F.when(status == "failed", 96.0).when(status == "degraded", 84.0))


def resolve_target(families: DataFrame, asked: str | None = None, profile: str | None = None) -> DataFrame:
    """One row (family, confidence, ambiguous): the host asked for, else the profile's, else the top score.

    A top score that leads the next by less than 3 is ambiguous.
    """
    given = asked or profile
    if given is not None:
        return families.limit(0).select("family").unionByName(
            families.sparkSession.range(1).select(F.lit(given).alias("family"))
        ).select("family", F.lit(100.0 if asked else 95.0).alias("confidence"), F.lit(False).alias("ambiguous"))
    top = families.orderBy(F.col("score").desc(), "family").limit(2).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "family"))).alias("t")
    ).where(F.size("t") > 0)
    lead = F.coalesce(F.get("t", F.lit(1))["minus"] - F.get("t", F.lit(0))["minus"], F.lit(1_000_000))
    return top.select(
        F.get("t", F.lit(0))["family"].alias("family"), F.when(lead < 3, 45.0).otherwise(72.0).alias("confidence"), (lead < 3).alias("ambiguous")
    )


def anomaly_severity(zero_windows: Column) -> Column:
    """high for intervals with a zero window, else medium."""
    return F.when(zero_windows > 0, "high").otherwise("medium")


def histogram_p95(histogram: Column, open_end: float = 2000.0) -> Column:
    """The upper bound of the bucket that reaches 95 % of a histogram's count; null if it is empty."""
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, b: a + b["count"])
    bound = lambda b: F.when(b["upper_bound_ms"] == "inf", open_end).otherwise(b["upper_bound_ms"].try_cast("double"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("at"))
    fold = F.aggregate(
        histogram, start,
        lambda acc, b: F.struct(
            (acc["seen"] + b["count"]).alias("seen"),
            F.when(acc["at"].isNull() & (acc["seen"] + b["count"] >= total * 0.95), bound(b)).otherwise(acc["at"]).alias("at"),
        ),
    )
    return F.when(total > 0, fold["at"])


def histogram_mean(histogram: Column, open_end: float = 2000.0) -> Column:
    """The mean of the buckets' bounds by count; null if it is empty."""
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, b: a + b["count"])
    bound = lambda b: F.when(b["upper_bound_ms"] == "inf", open_end).otherwise(b["upper_bound_ms"].try_cast("double"))
    weighted = F.aggregate(histogram, F.lit(0.0), lambda a, b: a + b["count"] * bound(b))
    return F.when(total > 0, weighted / total)


def host_filter(rows: DataFrame, hosts: str, wanted: list[str]) -> DataFrame:
    """Rows one of whose hosts is, or lies under, one of the wanted ones."""
    matched = F.lit(False)
    for name in wanted:
        matched = matched | _under(hosts, name)
    return rows.where(matched)


def _under(hosts: str, name: str) -> Column:
    return F.exists(hosts, lambda h: fields.host_matches(h, F.lit(name)))
