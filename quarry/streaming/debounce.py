"""Bursts of changes as a stream: a project's events wait in state until the project has been silent, then come out together.

In event time a burst is a session window: each has a state of its own, and is over once the watermark is more than the gap behind its
last event, whatever order events came in: the bursts are those of debounce_sessions() on the same log, without what was late.  In
processing time it is over once nothing has come for the gap: for a tree that is watched, where time goes on though nothing happens.
Then the state of a project is a list of its waiting events, on which a timer stands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.workers import ship

BURST = "project string, session_start timestamp, session_end timestamp, n_events bigint, upserts array<string>, deletes array<string>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, event_id bigint, path string, op string")

    def _timer(self, ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for part in rows:
            own = [(int(a), int(i), p, o) for a, i, p, o in zip(part["at"], part["event_id"], part["path"], part["op"], strict=True)]
            if own:
                self.waiting.appendList(own)
        self._timer(timerValues.getCurrentProcessingTimeInMs() + self.gap)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = sorted(tuple(x) for x in self.waiting.get())
        self.waiting.clear()
        if held:
            yield pd.DataFrame([self._burst(key[0], held)])

    @staticmethod
    def _burst(project: str, events: list[tuple]) -> dict:
        last = {path: op for _, _, path, op in events}
        return {"project": project, "session_start": pd.Timestamp(events[0][0], unit="us"), "session_end": pd.Timestamp(events[-1][0], unit="us"), "n_events": len(events), "upserts": sorted(p for p, o in last.items() if o == "upsert"), "deletes": sorted(p for p, o in last.items() if o == "delete")}

    def close(self) -> None:
        pass


def _sessions(events: DataFrame, gap_ms: int) -> DataFrame:
    """BURST of events with a watermark, by the engine's own session windows."""
    each = events.groupBy("project", F.session_window("event_time", f"{gap_ms} milliseconds").alias("w")).agg(
        F.min("event_time").alias("session_start"), F.max("event_time").alias("session_end"), F.count("*").alias("n_events"), F.array_sort(F.collect_list(F.struct("path", "at", "event_id", "op"))).alias("e")
    )
    last = F.filter("e", lambda x, i: ~F.get(F.col("e"), i + 1)["path"].eqNullSafe(x["path"]) | (i == F.size("e") - 1))
    of = lambda op: F.transform(F.filter("last", lambda x: x["op"] == op), lambda x: x["path"])
    return each.withColumn("last", last).select("project", "session_start", "session_end", "n_events", of("upsert").alias("upserts"), of("delete").alias("deletes"))


def debounced(events: DataFrame, gap_ms: int = 5000, late: str | None = "10 seconds") -> DataFrame:
    """BURST rows of a stream of events (project, path, op, event_time, event_id).

    late: how far behind the newest an event may be; those later than that are dropped, but for what a burst that still waits takes in.
    None: by processing time.  A burst's events are one state, in one task, and must fit there."""
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withColumn("at", F.unix_micros("event_time"))
    if late:
        return _sessions(own.withWatermark("event_time", late), gap_ms)
    return own.select("project", "path", "op", "event_id", "at").groupBy("project").transformWithStateInPandas(Debounce(gap_ms), BURST, "append", "ProcessingTime")
