"""Queries over the ``events`` table: interval series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.plans.tables import table

INTERVAL_SECONDS = 3600


def interval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bytes (``value``) and throughput per hour since the first event and event type."""
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    first = events.agg(F.min("ts").alias("t0"))
    rel = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))
    slot = F.floor(rel / F.lit(INTERVAL_SECONDS * 1_000_000)).cast("bigint")
    return (
        events.crossJoin(F.broadcast(first))
        .withColumn("interval_start", slot * INTERVAL_SECONDS)
        .groupBy("interval_start", "event_type")
        .agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total_value"))
        .withColumn("value_per_second", F.round(F.col("total_value") / INTERVAL_SECONDS, 6))
    )


QUERIES = {"interval_metrics": interval_metrics}

ORACLE_SQL = {
    "interval_metrics": f"""
        WITH e AS (
          SELECT event_type, value,
                 (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // {INTERVAL_SECONDS * 1_000_000} AS slot
          FROM events)
        SELECT slot * {INTERVAL_SECONDS} AS interval_start, event_type, count(*) AS n_events,
               round(sum(value), 4) AS total_value,
               round(round(sum(value), 4) / {INTERVAL_SECONDS}, 6) AS value_per_second
        FROM e GROUP BY 1, 2""",
}
