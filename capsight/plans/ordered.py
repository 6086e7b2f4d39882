"""Order-dependent queries: gaps, drops, as-of values, caps, samples, latest rows, windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.operators import evaluation, series
from capsight.plans.packets import k_of, seconds_since_first
from capsight.plans.tables import table
from capsight.streaming import windows

HOUR = 3600


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seconds_since_first(table(spark, sf_dir, "events"))


_AT = """e AS (SELECT *, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS time,
    CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per hour and event type."""
    slot = F.floor(F.col("time") / HOUR).cast("long")
    return _events(spark, sf_dir).groupBy("event_type", slot.alias("slot")).agg(F.round(F.sum("value"), 4).alias("total"))


_HOURS = f"""{_AT}, i AS (SELECT event_type, CAST(floor(time / {HOUR}) AS BIGINT) AS slot, round(sum(value), 4) AS total FROM e GROUP BY 1, 2)"""


def gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses of users over a day."""
    found = series.with_gap(_events(spark, sf_dir).select("event_id", "user_id", "time"), "user_id", "time", "event_id")
    return found.where(F.col("gap") > 24 * HOUR).select("event_id", "user_id", F.round("gap", 6).alias("gap"))


def data_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that start well after all before them, of the same type, have ended."""
    rows = _events(spark, sf_dir).select("event_id", "event_type", "time", (F.col("time") + F.col("value")).alias("end_time"))
    return series.running_gaps(rows, "event_type", "time", "end_time", 2 * HOUR).select("event_id", "event_type", F.round("gap", 4).alias("gap"))


def drop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours well under the median of their event type."""
    return series.drops(_hours(spark, sf_dir), "event_type", "total").withColumn("baseline", F.round("baseline", 4))


def interval_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with a mark if they fall under half the median or the hour before."""
    return series.relative_anomaly(_hours(spark, sf_dir), "event_type", "slot", ("total",), ())


def interval_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal hours of each event type in one row."""
    rows = series.relative_anomaly(_hours(spark, sf_dir), "event_type", "slot", ("total",), ())
    return rows.where(~F.col("anomalous")).groupBy("event_type").agg(
        F.count("*").alias("n_normal"), F.round(F.sum("total"), 4).alias("total"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    )


def bounded_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 100 hours of clicks, anomalous ones first."""
    rows = series.relative_anomaly(_hours(spark, sf_dir), "event_type", "slot", ("total",), ()).where("event_type = 'click'")
    return series.bounded_series(rows, "anomalous", 100, "slot")


def asof_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's latest click."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return series.as_of(rows, "user_id", F.when(F.col("event_type") == "click", F.col("event_id")), "last_click", "event_id")


def capped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 800 events of each type, 3000 in all."""
    return series.capped(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 800, 3000, "event_id")


def head_tail_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five and last four events of each user."""
    return series.head_tail(table(spark, sf_dir, "events").select("user_id", "event_id"), 9, ("user_id",), "event_id")


def nearest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty events nearest to a time."""
    off = F.abs(F.col("time") - 1_000_000.0)
    return _events(spark, sf_dir).orderBy(off, "event_id").limit(50).select("event_id", F.round(off, 6).alias("distance"))


def bounded_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty users: those with many errors first, then by value."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(
        (F.count_if(F.col("event_type") == "error") > 15).alias("anomalous"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
    )
    return rows.orderBy(F.col("anomalous").desc(), F.col("cents").desc(), "user_id").limit(40)


def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last document of each source."""
    return series.latest(table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars"), "source", F.col("doc_id").desc())


def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four turns of each conversation, and how many came before."""
    return series.last_n(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", 4, "turn")


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, nearest-rank 95th percentile per return flag."""
    found = series.ranked(
        table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice",
        low=F.expr("(n + 1) div 2"), high=F.expr("n div 2 + 1"), p95=series.rank_of(95),
    )
    return found.select("l_returnflag", F.round(F.col("low") * 0.5 + F.col("high") * 0.5, 4).alias("p50"), "p95")


def multi_dim_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events grouped by type and by user, each on its own."""
    rows = table(spark, sf_dir, "events")
    return evaluation.by_each_dimension(rows, ["event_type", "user_id"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _named(rows: DataFrame) -> DataFrame:
    for c in ("window_start", "window_end"):
        rows = rows.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return rows


def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per hour."""
    return _named(windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value"))


def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per hour, every half hour."""
    return _named(windows.sliding(table(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", ["event_type"], "value"))


def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per session of a user: a pause of six hours ends one."""
    return _named(windows.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"], "value"))


def negative_time_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by whether their time, counted a day after the first one, is usable."""
    rows = _events(spark, sf_dir).withColumn("time", F.col("time") - 86_400.0)
    good, dead = windows.timely(rows, "time")
    return good.agg(F.count("*").alias("timely")).crossJoin(dead.agg(F.count("*").alias("dead")))


def multiway_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line revenue per nation."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.groupBy("n_name").agg(F.count("*").alias("n_lines"), F.sum("cents").alias("cents"))


QUERIES = {
    f.__name__: f
    for f in (
        gap_events, data_gaps, drop_events, interval_anomalies, interval_compression, bounded_series, asof_label, capped_evidence, head_tail_sample,
        nearest_events, bounded_flows, version_latest, session_turns, percentiles, multi_dim_groups, window_tumbling, window_sliding, window_session,
        negative_time_count, multiway_join,
    )
}

_ANOMALIES = f"""{_HOURS}, m AS (SELECT event_type, median(total) AS mid FROM i GROUP BY 1),
    l AS (SELECT i.*, mid, lag(total) OVER (PARTITION BY event_type ORDER BY slot) AS prev FROM i JOIN m USING (event_type)),
    a AS (SELECT event_type, slot, total, (mid > 0 AND total < mid * 0.5) OR coalesce(prev > 0 AND total < prev * 0.5, false) AS anomalous FROM l)"""
_FORMAT = "'%Y-%m-%d %H:%M:%S.%f'"

ORACLE_SQL = {
    "gap_events": f"""WITH {_AT}, g AS (SELECT event_id, user_id, time - lag(time) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM e)
        SELECT event_id, user_id, round(gap, 6) AS gap FROM g WHERE gap > {24 * HOUR}""",
    "data_gaps": f"""WITH {_AT}, g AS (SELECT event_id, event_type, time - max(time + value) OVER (PARTITION BY event_type ORDER BY time, time + value
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM e) SELECT event_id, event_type, round(gap, 4) AS gap FROM g WHERE gap > {2 * HOUR}""",
    "drop_events": f"""WITH {_HOURS}, b AS (SELECT event_type, median(total) AS m FROM i WHERE total > 0 GROUP BY 1)
        SELECT event_type, slot, total, round(m, 4) AS baseline FROM i JOIN b USING (event_type) WHERE total < m * 0.35""",
    "interval_anomalies": f"WITH {_ANOMALIES} SELECT * FROM a",
    "interval_compression": f"""WITH {_ANOMALIES} SELECT event_type, count(*) AS n_normal, round(sum(total), 4) AS total, min(slot) AS first_slot, max(slot) AS last_slot
        FROM a WHERE NOT anomalous GROUP BY 1""",
    "bounded_series": f"""WITH {_ANOMALIES}, c AS (SELECT * FROM a WHERE event_type = 'click'),
        n AS (SELECT count(*) FILTER (anomalous) AS x, count(*) FILTER (NOT anomalous) AS y FROM c),
        r AS (SELECT *, least(x, 100 - CASE WHEN x > 0 AND y > 0 AND x >= 100 THEN least(y, 10) ELSE 0 END) AS fx FROM n),
        b AS (SELECT fx, least(y, 100 - fx) AS fy FROM r),
        o AS (SELECT c.*, row_number() OVER (PARTITION BY anomalous ORDER BY slot) AS up, row_number() OVER (PARTITION BY anomalous ORDER BY slot DESC) AS dn,
                     CASE WHEN anomalous THEN fx ELSE fy END AS n FROM c, b)
        SELECT event_type, slot, total, anomalous FROM o WHERE up <= ceil(n / 2) OR dn <= floor(n / 2)""",
    "asof_label": """SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events""",
    "capped_evidence": """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)
        SELECT event_id, event_type FROM r WHERE n <= 800 ORDER BY event_id LIMIT 3000""",
    "head_tail_sample": """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS u,
          row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS d FROM events) SELECT user_id, event_id FROM r WHERE u <= 5 OR d <= 4""",
    "nearest_events": f"WITH {_AT} SELECT event_id, round(abs(time - 1000000), 6) AS distance FROM e ORDER BY abs(time - 1000000), event_id LIMIT 50",
    "bounded_flows": """SELECT user_id, count(*) FILTER (event_type = 'error') > 15 AS anomalous, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM events GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 40""",
    "version_latest": "SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1",
    "session_turns": """WITH r AS (SELECT conv_id, turn, role, greatest(count(*) OVER (PARTITION BY conv_id) - 4, 0) AS earlier,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, role, earlier FROM r WHERE n <= 4""",
    "percentiles": "SELECT l_returnflag, round(median(l_extendedprice), 4) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1",
    "multi_dim_groups": """SELECT CASE WHEN event_type IS NULL THEN 'user_id' ELSE 'event_type' END AS dimension, coalesce(event_type, CAST(user_id AS VARCHAR)) AS value,
        count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type), (user_id))""".replace("sum(value)", "sum(events.value)"),
    "window_tumbling": f"""WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, event_type, value FROM events)
        SELECT strftime(s, {_FORMAT}) AS window_start, strftime(s + INTERVAL '1 hour', {_FORMAT}) AS window_end, event_type,
               count(*) AS n_events, round(sum(value), 4) AS total FROM w GROUP BY s, event_type""",
    "window_sliding": f"""WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '1 minute' * b AS s, event_type, value
          FROM events, (SELECT unnest([0, 30]) AS b))
        SELECT strftime(s, {_FORMAT}) AS window_start, strftime(s + INTERVAL '1 hour', {_FORMAT}) AS window_end, event_type,
               count(*) AS n_events, round(sum(value), 4) AS total FROM w GROUP BY s, event_type""",
    "window_session": f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
        SELECT strftime(min(ts), {_FORMAT}) AS window_start, strftime(max(ts) + INTERVAL '6 hours', {_FORMAT}) AS window_end, user_id,
               count(*) AS n_events, round(sum(value), 4) AS total FROM s GROUP BY user_id, n""",
    "negative_time_count": f"WITH {_AT} SELECT count(*) FILTER (time >= 86400) AS timely, count(*) FILTER (time < 86400) AS dead FROM e",
    "multiway_join": """SELECT n_name, count(*) AS n_lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
}
