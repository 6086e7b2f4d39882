"""Answers matched to earlier questions on a stream, with state that expires; and the same in batch.

An answer meets the first tier, of keys in common, in which a question came before it by ``keep``
seconds at most: the older ones are forgotten, so state is bounded by what is asked in that time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the state store that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COLUMNS = ("seq", "time", "is_response", "id", "src", "dst", "name")


class Matcher(StatefulProcessor):
    """Rows of one id: they wait until the watermark has passed them, and are taken in order of (time, seq).

    State is read and written as a whole for each call, not row by row: every call to the store is a message to Spark.
    """

    def __init__(self, keep_seconds: float) -> None:
        self.keep = int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("rows", "ms long, seq long, is_response boolean, src string, dst string, name string")
        #: (tier, client, name) -> when it was last asked
        self.asked = handle.getMapState("asked", "tier int, client string, name string", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        first = None
        for part in rows:
            ms = (part["time"].to_numpy().astype("datetime64[us]").astype("int64") // 1000).tolist()
            known = [part[c].astype(object).where(part[c].notna(), None).tolist() for c in ("src", "dst", "name")]
            new = list(zip(ms, (int(x) for x in part["seq"]), (bool(x) for x in part["is_response"]), *known, strict=True))
            if new:
                self.waiting.appendList(new)
                first = min(ms) if first is None else min(first, *ms)
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"seq": [], "id": [], "tier": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        now = timerValues.getCurrentWatermarkInMs()
        waiting = {(row[0], row[1]): tuple(row) for row in self.waiting.get()}
        before = {tuple(t): ms for t, (ms,) in self.asked.iterator()}
        asked, found = dict(before), []
        for ms, seq in sorted(k for k in waiting if k[0] <= now):
            is_response, src, dst, name = waiting[ms, seq][2:]
            client = dst if is_response else src
            tiers = [(1, client or "", "" if name is None else f"={name}"), (2, client or "", ""), (3, "", "")]
            if client is None:  # no address equals an unknown one
                tiers = tiers[2:]
            if is_response:
                found.append((seq, key[0], next((t[0] for t in tiers if asked.get(t, ms - self.keep - 1) >= ms - self.keep), None)))
            else:
                asked |= dict.fromkeys(tiers, ms)
        recent = {t: ms for t, ms in asked.items() if ms >= now - self.keep}
        for t in before.keys() - recent.keys():
            self.asked.removeKey(t)
        for t, ms in recent.items():
            if before.get(t) != ms:
                self.asked.updateValue(t, (ms,))
        later = [row for k, row in waiting.items() if k[0] > now]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(row[0] for row in later))
        else:
            self.waiting.clear()
            if recent:
                self.handle.registerTimer(now + self.keep + 1)  # to forget what is asked now
        out = pd.DataFrame(found, columns=["seq", "id", "tier"])
        yield out.astype({"tier": "Int32"})

    def close(self) -> None:
        pass


def stream_matches(rows: DataFrame, keep_seconds: float, late: str) -> DataFrame:
    """(seq, id, tier) of each response on a stream of ``COLUMNS``; tier null if no question within ``keep_seconds`` meets it.

    Rows may come up to ``late`` out of order; what comes later is dropped. Rows of a null id are their own id.
    The session needs the setting STORE.
    """
    kind = rows.schema["id"].dataType.simpleString()
    chosen = rows.select(*COLUMNS).withWatermark("time", late)
    return chosen.groupBy("id").transformWithStateInPandas(Matcher(keep_seconds), f"seq long, id {kind}, tier int", "append", "EventTime")


def recent_matches(rows: DataFrame, keep_seconds: float) -> DataFrame:
    """The same from a table: each tier's last question before the response, by one window for each tier."""
    client, asked = F.when(F.col("is_response"), F.col("dst")).otherwise(F.col("src")), F.when(~F.col("is_response"), F.unix_millis("time"))
    tier = F.lit(None).cast("int")
    out = rows.withColumn("_client", client)
    for k, keys in ((3, ["id"]), (2, ["id", "_client"]), (1, ["id", "_client", "name"])):
        before = Window.partitionBy(*keys).orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, -1)
        known: Column = F.lit(True) if k == 3 else F.col("_client").isNotNull()
        out = out.withColumn(f"_last{k}", F.when(known, F.max(asked).over(before)))
        tier = F.when(F.col(f"_last{k}") >= F.unix_millis("time") - int(keep_seconds * 1000), k).otherwise(tier)
    return out.where("is_response").select("seq", "id", tier.alias("tier"))


def run_available(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Takes in what a stream's sources hold by now, appends its rows to Parquet below ``target``, and reads all of them.

    Run again with the same checkpoint, it goes on where it ended.
    """
    session = stream.sparkSession
    before = session.conf.get(STORE[0], None)
    session.conf.set(*STORE)
    try:
        writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        session.conf.unset(STORE[0]) if before is None else session.conf.set(STORE[0], before)
    return session.read.schema(stream.schema).parquet(target)
