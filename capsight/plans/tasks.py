"""Telemetry, task-log, queue and conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.functions import fields, texts
from capsight.operators import evidence, telemetry
from capsight.plans.packets import k_of
from capsight.plans.tables import table

#: Legal changes of the event types, read as a status.
LEGAL = {"view": ("view", "click", "signup"), "click": ("view", "purchase", "error"), "signup": ("click", "view"), "purchase": ("view",), "error": ("view", "error")}


def call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls, by type."""
    k = k_of()
    rows = table(spark, sf_dir, "events").select(
        "event_type", F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), (k % 3).alias("retries"),
        F.when(k % 10 != 0, k * 10).alias("input_tokens"), F.when(F.col("event_type") != "signup", k * 2).alias("output_tokens"),
        F.round(F.col("value") * 100).cast("long").alias("cost"), F.col("value").alias("latency_ms"),
    )
    return telemetry.call_summary(rows, "event_type")


def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of each turn, read and answered."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", texts.estimated_cost(F.length("text"), F.when(F.col("role") == "assistant", F.length("text")), 250.0, 1000.0).alias("cost"))


def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events with the one before, and whether the change is legal."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return telemetry.transitions(rows, "user_id", "event_type", "event_id", LEGAL)


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event."""
    return telemetry.task_states(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "analyzing").otherwise("completed").alias("status"),
        F.startswith("o_orderpriority", F.lit("5")).alias("cancel_requested"), F.col("o_orderdate").cast("timestamp").alias("heartbeat_at"),
    )


def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty oldest queued tasks."""
    return telemetry.queue_head(_tasks(spark, sf_dir), 50).select("task_id", "session_id")


def stale_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks under way that were silent on 1 January 1999."""
    return telemetry.stale(_tasks(spark, sf_dir), F.lit("1999-01-01 00:00:00").cast("timestamp"), 30.0).select("task_id", "status")


def crowded_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with several tasks under way."""
    return telemetry.crowded_sessions(_tasks(spark, sf_dir))


def semi_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders left after customers in debt are deleted."""
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return telemetry.without(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


def distinct_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return telemetry.without(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), asked, "c_custkey")


def event_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred events after a cursor."""
    return telemetry.after_cursor(table(spark, sf_dir, "events").select("event_id", "event_type"), 500)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each conversation's first user turn; each third one has a capture."""
    c = F.col("conv_id")
    lead = F.when(c % 5 == 0, "你好，请问：请帮我").when(c % 5 == 1, "帮我分析一下 C:\\caps\\a b.pcap；").when(c % 5 == 2, "sk-abcdefghijklmnop 请看看").otherwise("")
    said = F.when(c % 7 == 6, "谢谢。").otherwise(F.concat(lead, F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "conversations").where("turn = 0 and role = 'user'").select("conv_id", texts.title(said, c % 3 == 0).alias("title"))


def ratio_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the share of their balance in 10,000."""
    share = fields.ratio_percent(F.col("c_acctbal"), F.lit(10_000.0))
    return table(spark, sf_dir, "customer").groupBy(fields.binned(share, fields.RATIO_BINS).alias("bin")).agg(F.count("*").alias("n"))


def safe_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as maps without their sensitive keys."""
    values = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("api_key"), F.col("props"), F.lit("user"), F.col("user_id").cast("string"))
    kept = evidence.without_sensitive(values)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.map_keys(kept), ",").alias("keys"), F.array_join(F.map_values(kept), ",").alias("kept_values"))


QUERIES = {
    f.__name__: f
    for f in (
        call_summary, cost_estimate, state_transitions, task_states, queue_head, stale_tasks, crowded_sessions, semi_delete, distinct_unanswered,
        event_cursor, titles, ratio_bins, safe_projection,
    )
}

_LEGAL = " OR ".join(f"(previous = '{b}' AND event_type IN ({', '.join(repr(x) for x in a)}))" for b, a in LEGAL.items())

ORACLE_SQL = {
    "call_summary": """WITH e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
        SELECT event_type, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, CAST(sum(k % 3) AS BIGINT) AS retries,
               CAST(sum(k * 10) FILTER (k % 10 <> 0) AS BIGINT) AS input_tokens, CAST(sum(k * 2) FILTER (event_type <> 'signup') AS BIGINT) AS output_tokens,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cost, max(value) AS max_latency_ms FROM e GROUP BY 1""",
    "cost_estimate": """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN round(length(text) * 1250.0::DOUBLE / 1e6, 6) END AS cost FROM conversations""",
    "state_transitions": f"""WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
        SELECT *, coalesce({_LEGAL}, false) OR (previous IS NULL AND event_type = 'view') AS legal FROM p""",
    "task_states": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "queue_head": """SELECT o_orderkey AS task_id, o_custkey AS session_id FROM orders WHERE o_orderstatus = 'O' AND NOT starts_with(o_orderpriority, '5')
        ORDER BY o_orderdate, o_orderkey LIMIT 50""",
    "stale_tasks": """SELECT o_orderkey AS task_id, 'analyzing' AS status FROM orders WHERE o_orderstatus = 'P' AND epoch_us(TIMESTAMP '1999-01-01') - epoch_us(o_orderdate) > 90000000""",
    "crowded_sessions": "SELECT o_custkey AS session_id, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1 HAVING count(*) > 1",
    "semi_delete": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "distinct_unanswered": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "event_cursor": "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100",
    "titles": rf"""WITH c AS (SELECT conv_id, conv_id % 3 = 0 AS cap, CASE WHEN conv_id % 7 = 6 THEN '谢谢。' ELSE CASE conv_id % 5 WHEN 0 THEN '你好，请问：请帮我' WHEN 1 THEN '帮我分析一下 C:\caps\a b.pcap；'
            WHEN 2 THEN 'sk-abcdefghijklmnop 请看看' ELSE '' END || coalesce(text, '') END AS t FROM conversations WHERE turn = 0 AND role = 'user'),
        h AS (SELECT conv_id, cap, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i)(?:sk-[a-z0-9_-]{{12,}}|(?:api[_-]?key|authorization)\s*[:=]\s*\S+)', '{texts.SECRET_MARK}', 'g'),
            '(?i)(^|\W)((?:[a-z]:[\\/]|/users/|/home/|/private/|/tmp/|~[/\\])[^\n，。；,;!?]*)', '\1{texts.PATH_MARK}', 'g'), '\s+', ' ', 'g')) AS p FROM c),
        a AS (SELECT *, trim(regexp_replace(p, '{texts.TITLE_LEAD}', ''), '{texts.LEAD_ENDS}') AS s FROM h),
        b AS (SELECT * REPLACE (trim(regexp_replace(s, '{texts.TITLE_LEAD}', ''), '{texts.LEAD_ENDS}') AS s) FROM a),
        d AS (SELECT * REPLACE (replace(replace(trim(regexp_replace(s, '{texts.TITLE_LEAD}', ''), '{texts.LEAD_ENDS}'), '{texts.PATH_MARK}', '{texts.PATH_NAME}'), '{texts.SECRET_MARK}', '') AS s) FROM b),
        e AS (SELECT * REPLACE (trim(regexp_extract(s, '^[^\n。！？!?；;]*'), '{texts.TITLE_ENDS}') AS s) FROM d)
        SELECT conv_id, CASE WHEN regexp_matches(p, '{texts.NO_TITLE}') OR s = '' OR regexp_matches(s, '{texts.NO_TITLE}') OR (cap AND length(s) < 4) THEN CASE WHEN cap THEN '{texts.CAPTURE_TITLE}' END
            WHEN length(s) <= 28 THEN s ELSE rtrim(left(s, 27)) || '…' END AS title FROM e""",
    "ratio_bins": """WITH s AS (SELECT round(c_acctbal / 10000.0 * 100, 3) AS p FROM customer)
        SELECT CASE WHEN p < 10 THEN '0-10pct' WHEN p < 30 THEN '10-30pct' WHEN p < 60 THEN '30-60pct' WHEN p < 90 THEN '60-90pct' WHEN p >= 90 THEN '90pct-plus' END AS bin,
               count(*) AS n FROM s GROUP BY 1""",
    "safe_projection": "SELECT event_id, 'kind,user' AS keys, event_type || ',' || user_id AS kept_values FROM events",
}
