"""Call telemetry, task logs and queues as event tables with derived state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsight.operators import series

_ENDS = ("completed", "partial", "failed", "cancelled", "interrupted")
#: The legal changes of a task's status.
TRANSITIONS = {
    "draft": ("awaiting_confirmation",),
    "awaiting_confirmation": ("queued", "cancelled"),
    "queued": ("validating", "cancelled"),
    "validating": ("analyzing", "failed", "cancelled", "interrupted"),
    "analyzing": ("reasoning", "verifying", "reporting", *_ENDS),
    "reasoning": ("verifying", "reporting", *_ENDS),
    "verifying": ("reporting", *_ENDS),
    "reporting": _ENDS,
}
ACTIVE = ("validating", "analyzing", "reasoning", "verifying", "reporting")
LEAST_TIMEOUT = 15.0


def call_summary(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, failures, retries, tokens and cost per group. Sums leave out nulls and are null over nulls only."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") != "ok").alias("failures"), F.sum("retries").alias("retries"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"),
        F.max("latency_ms").alias("max_latency_ms"),
    )


def transitions(log: DataFrame, task: str, status: str, seq: str, legal: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The log with ``previous`` status and whether the change is legal; a task must start with the first status."""
    legal = TRANSITIONS if legal is None else legal
    w = Window.partitionBy(task).orderBy(seq)
    allowed = F.lit(False)
    for before, after in legal.items():
        allowed = allowed | ((F.col("previous") == before) & F.col(status).isin(*after))
    first = F.col("previous").isNull() & (F.col(status) == next(iter(legal)))
    return log.withColumn("previous", F.lag(status).over(w)).withColumn("legal", F.coalesce(allowed, F.lit(False)) | F.coalesce(first, F.lit(False)))


def task_states(log: DataFrame, task: str, seq: str) -> DataFrame:
    """The last event of each task."""
    return series.latest(log, task, F.col(seq).desc())


def queue_head(tasks: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` oldest queued tasks that nobody cancelled."""
    return tasks.where("status = 'queued' and not cancel_requested").orderBy("created_at", "task_id").limit(n)


def stale(tasks: DataFrame, now: Column, heartbeat_seconds: float) -> DataFrame:
    """Active tasks whose worker has been silent for three heartbeats, and 15 seconds at least."""
    limit = max(LEAST_TIMEOUT, 3 * heartbeat_seconds)
    return tasks.where(F.col("status").isin(*ACTIVE) & (F.unix_micros(now) - F.unix_micros("heartbeat_at") > int(limit * 1e6)))


def crowded_sessions(tasks: DataFrame) -> DataFrame:
    """Sessions with more than one task under way: there must be none."""
    return tasks.where(F.col("status").isin("queued", *ACTIVE)).groupBy("session_id").agg(F.count("*").alias("n")).where("n > 1")


def after_cursor(log: DataFrame, cursor: int, most: int = 100) -> DataFrame:
    """The next events after a cursor."""
    return log.where(F.col("event_id") > cursor).orderBy("event_id").limit(most)


def without(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't removed: the cascade of a deletion to a dependent table."""
    return rows.join(removed.select(key), key, "left_anti")
