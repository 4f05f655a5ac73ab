"""Call rates with keyed state: for each event, how many calls of its key the seconds before it hold, itself included, as the batch window
counts them (``records.calls_in_window``).

A key's events wait in its state until the watermark has passed them, so rows that come out of order within the lateness count
exactly; then they are given out in order, and only as much of the past is kept as a later event may look back to. Rows later than the watermark are
left out, as a stream's rows are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State of a key: events that wait (place in the stream's order of ids, microseconds), and times that were given out.
_WAITING, _PAST = "event_id long, at long", "at long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _put(state, values: list) -> None:
    """Sets a list state, which may not be written empty."""
    if values:
        state.put(values)
    else:
        state.clear()


class CallsInWindow(StatefulProcessor):
    def __init__(self, seconds: int):
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.past = handle.getListState("past", _PAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            events = list(zip(batch["event_id"].tolist(), batch["at"].tolist(), strict=True))
            self.waiting.appendList(events)
            # A timer for each whole second: it fires when no event before it can come any more.
            for second in {-(-at // 1_000_000) for _, at in events}:
                self.handle.registerTimer(second * 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = list(self.waiting.get())
        ready = sorted((at, event) for event, at in waiting if at <= until)
        if not ready:
            yield pd.DataFrame()
            return
        past = [at for (at,) in self.past.get()]
        times = np.array(sorted([*past, *(at for at, _ in ready)]))
        asked = np.array([at for at, _ in ready])
        recent = np.searchsorted(times, asked, side="right") - np.searchsorted(times, asked - self.span, side="left")
        _put(self.waiting, [(event, at) for event, at in waiting if at > until])
        _put(self.past, [(int(at),) for at in times[times > until - self.span]])
        yield pd.DataFrame({"key": [str(key[0])] * len(ready), "event_id": [event for _, event in ready], "at": pd.to_datetime(asked, unit="us", utc=True), "recent": recent.astype("int64")})

    def close(self) -> None:
        pass


def calls_in_window(stream: DataFrame, key: str, at: str, event_id: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, event_id, at, recent) of a stream's events, in append mode; the key as a string. The session's state store keeps its tables in RocksDB."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = stream.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("long").alias("event_id"), F.col(at).cast("timestamp").alias("time")).withColumn("at", F.unix_micros("time"))
    keyed = timed.withWatermark("time", late).groupBy("key")
    return keyed.transformWithStateInPandas(CallsInWindow(seconds), "key string, event_id long, at timestamp, recent long", "Append", "EventTime")


def over_limit(calls: DataFrame, most: int) -> DataFrame:
    """The events that a limit of ``most`` calls a window refuses."""
    return calls.where(F.col("recent") > most)
