"""Queries that run as streams: over ``events`` as a table that files are added to, and as lines of growing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.plans.packets import k_of
from capsight.plans.tables import table
from capsight.sources import event_log
from capsight.sources.storage import shared_folder
from capsight.streaming import matching, windows

KEEP, LATE = 2 * 86_400.0, "1 hour"
LOGS, TAIL = 32, 5


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. The brackets make a pattern of the path, which a single file may have."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def name_rows(events: DataFrame) -> DataFrame:
    """``events`` as name questions and answers of users and one server."""
    reply, client = F.col("event_type").isin("purchase", "error"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return events.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("time"), reply.alias("is_response"), k_of().alias("id"),
        F.when(reply, "server").otherwise(client).alias("src"), F.when(reply, client).otherwise("server").alias("dst"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("host"), (F.col("user_id") % 7).cast("string"))).alias("name"),
    )


def stream_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer that the watermark has passed, with the tier of its question of the last two days; run as a stream."""
    found = matching.stream_matches(name_rows(_stream(spark, sf_dir, "events")), KEEP, LATE)
    folder = shared_folder(spark, "matches")
    return matching.run_available(found, f"{folder}/rows", f"{folder}/checkpoint")


def recent_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer with the tier of its question of the last two days."""
    return matching.recent_matches(name_rows(table(spark, sf_dir, "events")), KEEP)


def _logs(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder of JSON-line logs with ``events``, each tenth one written twice, and lines that are no events."""
    folder = shared_folder(spark, name)
    rows = table(spark, sf_dir, "events").withColumn("log", F.col("user_id") % LOGS)
    line = F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "event_type", "value"))
    lines = F.array_compact(F.array(line, F.when(F.col("event_id") % 10 == 0, line), F.when(F.col("event_id") % 50 == 0, F.lit("not an event")), F.when(F.col("event_id") % 70 == 0, F.lit(""))))
    ordered = rows.select("log", "event_id", F.posexplode(lines).alias("place", "value")).repartition(LOGS, "log").sortWithinPartitions("log", "event_id", "place")
    ordered.select("log", "value").write.partitionBy("log").text(folder)
    return folder


_FIELDS = "event_id long, ts timestamp, event_type string, value double"


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by event type of logs that a stream has read, each event once; kept by type in a partitioned sink."""
    folder, target = _logs(spark, sf_dir, "logs"), shared_folder(spark, "log-rows")
    events = windows.deduplicated(event_log.parsed(event_log.stream(spark, folder).select("line"), _FIELDS), "ts", ["event_id"], "1 day")
    sink = windows.into_partitions(f"{target}/rows", "event_type")
    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", f"{target}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"batch long, {_FIELDS}").parquet(f"{target}/rows")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last"))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events among the last lines of each log."""
    found = event_log.tail(spark, _logs(spark, sf_dir, "logs"), TAIL)
    return event_log.parsed(found, _FIELDS).select("event_id", "event_type", F.round("value", 4).alias("value"))


QUERIES = {f.__name__: f for f in (stream_match, recent_match, stream_log, log_tail)}

_MATCH = f"""
    r AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ms, event_type IN ('purchase', 'error') AS answer, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS id,
                 user_id AS client, CASE WHEN user_id % 3 <> 0 THEN 'host' || (user_id % 7) END AS name, ts FROM events),
    m AS (SELECT *, max(CASE WHEN NOT answer THEN ms END) OVER (PARTITION BY id, client, name ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
                 max(CASE WHEN NOT answer THEN ms END) OVER (PARTITION BY id, client ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
                 max(CASE WHEN NOT answer THEN ms END) OVER (PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM r),
    t AS (SELECT seq, id, ms, CASE WHEN a >= ms - {int(KEEP * 1000)} THEN 1 WHEN b >= ms - {int(KEEP * 1000)} THEN 2 WHEN c >= ms - {int(KEEP * 1000)} THEN 3 END AS tier FROM m WHERE answer)"""

ORACLE_SQL = {
    "stream_match": f"WITH {_MATCH} SELECT seq, id, tier FROM t WHERE ms <= (SELECT max(ms) FROM r) - 3600000",
    "recent_match": f"WITH {_MATCH} SELECT seq, id, tier FROM t",
    "stream_log": """SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last FROM events GROUP BY 1""",
    "log_tail": f"""
        WITH x AS (SELECT *, unnest(list_concat([1], CASE WHEN event_id % 10 = 0 THEN [2] ELSE [] END, CASE WHEN event_id % 50 = 0 THEN [3] ELSE [] END,
                                             CASE WHEN event_id % 70 = 0 THEN [4] ELSE [] END)) AS place FROM events),
        y AS (SELECT *, row_number() OVER (PARTITION BY user_id % {LOGS} ORDER BY event_id DESC, place DESC) AS n FROM x)
        SELECT event_id, event_type, round(value, 4) AS value FROM y WHERE n <= {TAIL} AND place <= 2""",
}
