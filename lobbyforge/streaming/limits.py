"""Limits on calls: a sliding log with a queue before it as a stream with state, and fixed windows."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import order
from ..sources import store
from .usage import latest_by_key

#: (calls, microseconds): so many in any span so long; those of a key under development (fixed values of the service).
WINDOWS = ((20, 1_000_000), (100, 120_000_000))
STATE = "hits array<bigint>, clock bigint, waiting array<struct<rank:bigint,at:bigint,event_id:bigint>>"
ADMITTED = "key string, event_id bigint, admitted bigint, waits boolean"


class Log:
    """Calls admitted last, and those that wait: highest priority first, then by arrival."""

    def __init__(self, windows: tuple[tuple[int, int], ...], hits: list[int], clock: int, waiting: list[tuple[int, int, int]]):
        self.windows, self.hits, self.clock, self.waiting = windows, hits, clock, waiting
        self.most = max(n for n, _ in windows)

    def free(self) -> int:
        """When the next call may pass: each window's earliest call that counts must have left it."""
        return max([self.clock, *(self.hits[-n] + span for n, span in self.windows if len(self.hits) >= n)])

    def drain(self, before: int | None) -> Iterator[tuple[int, int]]:
        """(event, time) of the calls that pass before a time; those that come at this time are in the queue by then."""
        while self.waiting and (before is None or self.free() < before):
            self.clock = self.free()
            _, _, event = heappop(self.waiting)
            self.hits = [*self.hits[1 - self.most :], self.clock] if self.most > 1 else [self.clock]
            yield event, self.clock

    def arrive(self, priority: int, at: int, event: int) -> Iterator[tuple[int, int]]:
        yield from self.drain(at)
        self.clock = max(self.clock, at)
        heappush(self.waiting, (-priority, at, event))


class SlidingLog(StatefulProcessor):
    """Admits the calls of a key.  A row says when a call passes; while it waits, when it would if no other came.

    A timer at the next free slot admits what waits once event time has passed it, so calls
    become final without another call of their key.
    """

    def __init__(self, windows: tuple[tuple[int, int], ...]):
        self.windows = windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("log", STATE)

    def load(self) -> Log:
        if not self.state.exists():
            return Log(self.windows, [], 0, [])
        hits, clock, waiting = self.state.get()
        return Log(self.windows, list(hits), clock, [tuple(w) for w in waiting])

    def keep(self, key, log: Log, passed: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        self.state.update((log.hits, log.clock, log.waiting))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if log.waiting:
            self.handle.registerTimer(log.free() // 1000 + 1)
        planned = list(Log(self.windows, log.hits, log.clock, list(log.waiting)).drain(None))
        rows = [(str(key[0]), e, t, False) for e, t in passed] + [(str(key[0]), e, t, True) for e, t in planned]
        yield pd.DataFrame(rows, columns=["key", "event_id", "admitted", "waits"]).astype({"key": "object", "event_id": "int64", "admitted": "int64", "waits": "bool"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log, passed = self.load(), []
        calls = sorted((r.at, r.event_id, r.priority) for part in rows for r in part.itertuples())
        for at, event, priority in calls:  # one that comes late joins the queue at the log's time
            passed += log.arrive(int(priority), int(at), int(event))
        yield from self.keep(key, log, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        log = self.load()
        passed = list(log.drain(timerValues.getCurrentWatermarkInMs() * 1000))
        yield from self.keep(key, log, passed)

    def close(self) -> None:
        pass


def admitted(calls: DataFrame, windows: tuple[tuple[int, int], ...] = WINDOWS, lateness: str = "10 minutes") -> DataFrame:
    """(event_id, admitted): when each call of a stream (key, event_id, ts, priority) may pass, in microseconds."""
    spark = calls.sparkSession
    stream = calls.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    provider, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, rocks)
    try:
        rows = stream.groupBy("key").transformWithStateInPandas(SlidingLog(windows), ADMITTED, "Update", "EventTime")
        return latest_by_key(rows, ["event_id"]).select("event_id", "admitted")
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)


def fixed_windows(calls: DataFrame, per_key: int, everyone: int, seconds: int) -> DataFrame:
    """(event_id, ok, scope, retry_after) of calls (key, event_id, ts) under a limit a key and one for all.

    Both count every call of a window, also those rejected; the key's limit is asked first.  The places of calls
    come from counts by second, so neither a busy window nor a busy key is one task.
    """
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = calls.withColumns({"window": F.floor(at / seconds), "second": at % seconds})
    by = [F.asc("ts"), F.asc("event_id")]
    rows = order.places(rows, ["window"], F.col("second"), by, "all_k")
    rows = order.places(rows, ["key", "window"], F.col("second"), by, "key_k")
    scope = F.when(F.col("key_k") > per_key, "ip").when(F.col("all_k") > everyone, "global")
    return rows.select("event_id", scope.isNull().alias("ok"), scope.alias("scope"), F.when(scope.isNull(), 0).otherwise(seconds - F.col("second")).cast("long").alias("retry_after"))
