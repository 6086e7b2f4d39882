"""Structured Streaming over event rows: tumbling, sliding and session windows, deduplication, sinks.

Each function takes a streaming or batch DataFrame, so one definition serves both; on a stream the
watermark bounds the state, and what comes later than it is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _totals(value: str) -> list:
    return [F.count("*").alias("n_events"), F.round(F.sum(value), 4).alias("total")]


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and keys."""
    return _flat(events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*_totals(value)))


def sliding(events: DataFrame, time: str, width: str, step: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per overlapping window and keys."""
    return _flat(events.withWatermark(time, late).groupBy(F.window(time, width, step), *keys).agg(*_totals(value)))


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per session: a pause of ``gap`` ends one."""
    return _flat(events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*_totals(value)))


def _flat(windowed: DataFrame) -> DataFrame:
    rest = [c for c in windowed.columns if c != "window"]
    return windowed.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def timely(events: DataFrame, seconds: str) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters): a negative or missing relative time is set aside."""
    good = F.coalesce(F.col(seconds) >= 0, F.lit(False))
    return events.where(good), events.where(~good)


def into_partitions(path: str, *partitions: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each batch goes to its own folder and is written over on a repeat, so nothing counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/batch={number}")

    return write
