"""A task queue on a stream: claims go to the oldest task, silent workers are interrupted; timers go by the clock."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from capsight.operators.telemetry import LEAST_TIMEOUT


def timeout_ms(heartbeat_seconds: float) -> int:
    """How long a worker may be silent: three heartbeats, 15 seconds at least."""
    return int(1000 * max(LEAST_TIMEOUT, 3 * heartbeat_seconds))


class Queue(StatefulProcessor):
    """One queue: tasks in order of arrival, and who works on which.

    Rows are of kind ``queued`` (task_id), ``cancelled`` (task_id), ``claim`` (worker), ``heartbeat`` (task_id, worker)
    or ``done`` (task_id, worker). Since a key's rows are one task's, two claims never get the same task.
    """

    def __init__(self, silent_ms: int) -> None:
        self.silent = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "place long, task_id long", "queued boolean")
        self.active = handle.getMapState("active", "task_id long", "worker string, deadline long")
        self.places = handle.getValueState("places", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        now, found = timerValues.getCurrentProcessingTimeInMs(), []
        events = pd.concat(list(rows)).sort_values("seq")
        for row in events.itertuples(index=False):
            if row.kind == "queued":
                place = self.places.get()[0] + 1 if self.places.exists() else 1
                self.places.update((place,))
                self.open.updateValue((place, int(row.task_id)), (True,))
            elif row.kind == "cancelled":
                for place in [p for p in self.open.keys() if p[1] == row.task_id]:
                    self.open.removeKey(tuple(place))
                    found.append((int(row.task_id), None, "cancelled"))
            elif row.kind == "claim":
                first = min((tuple(p) for p in self.open.keys()), default=None)
                if first is None:
                    found.append((None, row.worker, "nothing"))
                    continue
                self.open.removeKey(first)
                self._seen(first[1], row.worker, now)
                found.append((first[1], row.worker, "claimed"))
            elif self.active.containsKey((int(row.task_id),)) and self.active.getValue((int(row.task_id),))[0] == row.worker:
                if row.kind == "heartbeat":
                    self._seen(int(row.task_id), row.worker, now)
                else:
                    self.active.removeKey((int(row.task_id),))
                    found.append((int(row.task_id), row.worker, "completed"))
            else:  # a worker that was given up, or never had the task
                found.append((int(row.task_id), row.worker, "rejected"))
        yield _output(key[0], found)

    def _seen(self, task: int, worker: str, now: int) -> None:
        self.active.updateValue((task,), (worker, now + self.silent))
        self.handle.registerTimer(now + self.silent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        now, found = timerValues.getCurrentProcessingTimeInMs(), []
        for (task,), (worker, deadline) in list(self.active.iterator()):
            if deadline <= now:  # later heartbeats have moved it, else
                self.active.removeKey((task,))
                found.append((task, worker, "interrupted"))
        yield _output(key[0], found)

    def close(self) -> None:
        pass


def _output(queue: object, found: list[tuple]) -> pd.DataFrame:
    rows = [(queue, *row) for row in found]
    return pd.DataFrame(rows, columns=["queue", "task_id", "worker", "event"]).astype({"task_id": "Int64", "worker": object, "event": object})


def queue_events(rows: DataFrame, queue: str, heartbeat_seconds: float, silent_ms: int | None = None) -> DataFrame:
    """(queue, task_id, worker, event) of a stream of (queue, seq, kind, task_id, worker): claimed, nothing, completed,
    cancelled, rejected, or interrupted once the clock has passed a worker's last sign by its limit.
    """
    silent = timeout_ms(heartbeat_seconds) if silent_ms is None else silent_ms
    chosen, kind = rows.select(queue, "seq", "kind", "task_id", "worker"), rows.schema[queue].dataType.simpleString()
    output = f"queue {kind}, task_id long, worker string, event string"
    return chosen.groupBy(queue).transformWithStateInPandas(Queue(silent), output, "append", "ProcessingTime")
