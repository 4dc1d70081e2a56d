"""Restart alarms, watchdogs and operational status."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliomill import states


def rolling_alarm(events: DataFrame, key: list[str] | None = None, seconds: int = states.RESTART_ALARM_SECONDS, count: int = states.RESTART_ALARM_COUNT) -> DataFrame:
    """Events (ts) with recent, how many fell within the last seconds (the cutoff inclusive), and alarm.

    Events are counted within slices of that many seconds, each together with the slice before, so no
    task holds more than two slices' events of a key.
    """
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    keys = list(key or [])
    # an event counts in its own slice of time and, to be seen from there, in the next
    width = max(seconds, 1)
    home = F.floor(at / width)
    doubled = events.withColumn("__at", at).withColumn("__home", home).withColumn("__slice", F.explode(F.array(home, home + 1)))
    window = Window.partitionBy(*keys, "__slice").orderBy("__at").rangeBetween(-seconds, 0)
    counted = doubled.withColumn("recent", F.count("*").over(window)).where("__slice = __home")
    return counted.drop("__at", "__home", "__slice").withColumn("alarm", F.col("recent") >= count)


def stream_alarm(events: DataFrame, lateness: str = "10 minutes", count: int = states.RESTART_ALARM_COUNT) -> DataFrame:
    """Sliding windows of 15 minutes, one a minute, with their restarts, for charts; stream_rolling_alarm is exact. Events later than lateness do not count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", "15 minutes", "1 minute")).agg(F.count("*").alias("restarts")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "restarts", (F.col("restarts") >= count).alias("alarm")
    )


class AlarmWindow(StatefulProcessor):
    """X7 for one slice of a key's time: its events that wait for the clock to pass their second, and how many fell on each second of it and of the window before.

    The slice's number is the last of the key; its state ends when the clock has passed its end.
    """

    def __init__(self, seconds: int, count: int, width: int):
        self.seconds, self.count, self.width = seconds, count, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("events", "told array<long>, n array<long>, at array<long>, id array<string>")

    def _held(self) -> tuple[list, list, list, list]:
        return tuple(map(list, self.state.get())) if self.state.exists() else ([], [], [], [])

    def _keep(self, end: int, told: list, n: list, at: list, ids: list) -> None:
        """Holds what is left, with one timer: for the earliest event that waits, or else for the end of the slice."""
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.state.update((told, n, at, ids))
        self.handle.registerTimer(1000 * (min(at) // 1_000_000 + 1 if at else end))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told, n, at, ids = self._held()
        passed = timerValues.getCurrentWatermarkInMs()
        fell = [np.repeat(np.array(told, np.int64), n)]
        for batch in rows:
            in_time = batch[1000 * (batch["at"] // 1_000_000 + 1) > passed]
            fell.append(in_time["at"].to_numpy() // 1_000_000)
            own = in_time[in_time["own"]]
            at += own["at"].tolist()
            ids += own["id"].tolist()
        seconds, sizes = np.unique(np.concatenate(fell), return_counts=True)
        if len(seconds):
            self._keep(self.width * (int(key[-1]) + 1), seconds.tolist(), sizes.tolist(), at, ids)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told, n, at, ids = self._held()
        clock, end = timerValues.getCurrentWatermarkInMs() // 1000, self.width * (int(key[-1]) + 1)
        second = np.array(at, np.int64) // 1_000_000
        order = np.argsort(second, kind="stable")
        ready, waits = order[second[order] < clock], order[second[order] >= clock]
        before = np.r_[0, np.cumsum(np.array(n, np.int64))]
        recent = before[np.searchsorted(told, second[ready], "right")] - before[np.searchsorted(told, second[ready] - self.seconds, "left")]
        if clock >= end:
            self.state.clear()
        else:
            self._keep(end, told, n, [at[k] for k in waits], [ids[k] for k in waits])
        if len(ready):
            out = {f"key{k}": [value] * len(ready) for k, value in enumerate(key[:-1])}
            yield pd.DataFrame({**out, "id": [ids[k] for k in ready], "at": [at[k] for k in ready], "recent": recent, "alarm": recent >= self.count})

    def close(self) -> None:
        pass


def stream_rolling_alarm(
    events: DataFrame, key: list[str], event_id: str, lateness: str = "10 minutes", seconds: int = states.RESTART_ALARM_SECONDS, count: int = states.RESTART_ALARM_COUNT
) -> DataFrame:
    """W8 over a stream of events (ts, event_id and key columns): key, event_id (as a string), ts, recent and alarm of each.

    An event is told, once, as soon as event time less lateness has passed its second, since then no event
    that counts for it can still come; so the stream gives what rolling_alarm gives, whatever the order in
    which events come within lateness. Later ones do not count. A key's time is cut into slices of four
    windows, each with a state of its own, which holds its events of lateness and a number for each second
    of the slice and of the window before, and ends with it; an event near a slice's end counts in the next
    slice too. So frequent keys are many states. Needs the RocksDB state store.
    """
    width = 4 * max(seconds, 1)
    second = F.unix_seconds("ts")
    home = F.floor(second / width)
    place = lambda number, own: F.struct(number.alias("slice"), F.lit(own).alias("own"))
    places = F.when(second + seconds >= width * (home + 1), F.array(place(home, True), place(home + 1, False))).otherwise(F.array(place(home, True)))
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    slim = timed.select(*[F.col(c).cast("string").alias(f"key{k}") for k, c in enumerate(key)], F.lit("").alias("all"), F.col(event_id).cast("string").alias("id"), F.unix_micros("ts").alias("at"), "ts", F.explode(places).alias("place")).select("*", "place.*").drop("place")
    names = [f"key{k}" for k in range(len(key))] or ["all"]
    schema = ", ".join([f"key{k} string" for k in range(max(len(key), 1))] + ["id string", "at long", "recent long", "alarm boolean"])
    found = slim.groupBy(*names, "slice").transformWithStateInPandas(AlarmWindow(seconds, count, width), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return found.select(*[F.col(f"key{k}").alias(c) for k, c in enumerate(key)], F.col("id").alias(event_id), F.timestamp_micros("at").alias("ts"), "recent", "alarm")


def operational_status(status_events: DataFrame, jobs: DataFrame, restarts: DataFrame, outputs: DataFrame, as_of) -> DataFrame:
    """One row: ok or degraded, why, and the backlog.

    status_events: probe (engine_reachable, outbox_writable, database_writable, loop_running, last_refusal),
    value (boolean), ts; of each probe the latest up to as_of holds, and one never seen counts as bad
    (last_refusal as good).
    """
    seen = status_events.where(F.col("ts") <= as_of)
    last = lambda p: F.max_by(F.col("value"), F.when(F.col("probe") == p, F.col("ts")))
    probes = seen.agg(*[F.coalesce(last(p), F.lit(False)).alias(p) for p in ("engine_reachable", "outbox_writable", "database_writable", "loop_running", "last_refusal")])
    since = F.unix_seconds(as_of.cast("timestamp")) - states.RESTART_ALARM_SECONDS
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    recent = restarts.where((at >= since) & (F.col("ts") <= as_of)).agg(F.count("*").alias("engine_restarts_recent"))
    waiting = jobs.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status").isin(*states.CONVERTING)).alias("converting"))
    rows = probes
    for more in (recent, waiting, outputs.agg(F.count("*").alias("documents"))):
        rows = rows.unionByName(more, allowMissingColumns=True)
    one = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    stalled = F.col("last_refusal") | (F.col("engine_restarts_recent") >= states.RESTART_ALARM_COUNT) | ~F.col("loop_running")
    good = F.col("engine_reachable") & F.col("outbox_writable") & F.col("database_writable") & ~stalled
    return one.withColumn("stalled", stalled).withColumn("status", F.when(good, "ok").otherwise("degraded"))
