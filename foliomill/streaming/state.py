"""Folding status events into the current state, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliomill import states

OUTPUT = "job_id string, status string, at long, seq long, engine_task_id string, queue_position int, started long, queued_times long"


def _complete(events: DataFrame) -> DataFrame:
    """events with a task and a queue position, null where they have none, and their order."""
    for name, kind in (("engine_task_id", "string"), ("queue_position", "int")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    return events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("place", F.struct("at", "seq"))


def fold_states(events: DataFrame) -> DataFrame:
    """Per job_id its state, when it got it, its task, queue position, start, and how often it was queued.

    events: job_id, status, ts, seq, and engine_task_id and queue_position where known. The latest event
    holds, but a job never leaves its first terminal state. Queueing clears task, position and start;
    submitting gives task and position, running start and position. Aggregations, so replays of the same
    events change nothing.
    """
    rows = _complete(events)
    over = F.col("status").isin(*states.TERMINAL)
    ends = rows.where(over).groupBy("job_id").agg(F.min("place").alias("end"))
    lived = rows.join(ends, "job_id", "left").where(F.col("end").isNull() | (F.col("place") <= F.col("end")))
    last = lambda kinds, value: F.max(F.when(F.col("status").isin(*kinds), F.struct("place", *value)))
    folded = lived.groupBy("job_id").agg(
        F.max(F.struct("place", "status", F.col("ts").alias("updated_at"))).alias("top"),
        last(["queued"], []).alias("queued"),
        last(["submitted"], ["engine_task_id"]).alias("task"),
        last(["submitted", "running"], ["queue_position"]).alias("seat"),
        last(["running"], ["ts"]).alias("run"),
        F.count_distinct(F.when(F.col("status") == "queued", F.col("seq"))).alias("queued_times"),
    )
    since = lambda c: F.coalesce(F.col(f"{c}.place") > F.col("queued.place"), F.lit(True))
    kept = lambda c, field: F.when(since(c), F.col(f"{c}.{field}"))
    return folded.select(
        "job_id", "top.status", "top.updated_at", F.col("top.place.seq").alias("seq"), kept("task", "engine_task_id").alias("engine_task_id"),
        kept("seat", "queue_position").alias("queue_position"), kept("run", "ts").alias("started_at"), "queued_times",
    )


def step(held: dict | None, event: dict) -> dict:
    """A job's state after one more event, which the states of fold_states follow."""
    over = event["status"] in states.TERMINAL
    new = (event["at"], event["seq"])
    if held is not None:
        old = (held["at"], held["seq"])
        ended = held["status"] in states.TERMINAL
        if ended and not (over and new < old) or not ended and not over and new <= old:
            return held
    out = dict(held or {"engine_task_id": None, "queue_position": None, "started": None, "queued_times": 0})
    out.update(status=event["status"], at=event["at"], seq=event["seq"])
    if event["status"] == "queued":
        out.update(engine_task_id=None, queue_position=None, started=None, queued_times=out["queued_times"] + 1)
    elif event["status"] == "submitted":
        out.update(engine_task_id=event["engine_task_id"], queue_position=event["queue_position"])
    elif event["status"] == "running":
        out.update(started=event["at"], queue_position=event["queue_position"])
    return out


class StateFold(StatefulProcessor):
    """X1 over a stream, for the jobs of one bucket: each job's row is what step makes of its events, in their order within a micro-batch.

    The state of a job that is over is dropped keep seconds of event time after its end. A bucket has one
    timer, for whichever of its jobs comes first, so Python is called once a bucket and not once a job.
    """

    FIELDS = ("status", "at", "seq", "engine_task_id", "queue_position", "started", "queued_times")

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("jobs", ", ".join(f"{name} array<{kind}>" for name, kind in (c.split() for c in OUTPUT.split(", "))))

    def _held(self) -> dict[str, dict]:
        if not self.state.exists():
            return {}
        ids, *columns = self.state.get()
        return {job: dict(zip(self.FIELDS, values)) for job, *values in zip(ids, *columns)}

    def _over_at(self, held: dict) -> int:
        return held["at"] // 1000 + 1000 * self.keep

    def _hold(self, jobs: dict[str, dict]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not jobs:
            self.state.clear()
            return
        self.state.update((list(jobs), *[[held[f] for held in jobs.values()] for f in self.FIELDS]))
        ends = [self._over_at(held) for held in jobs.values() if held["status"] in states.TERMINAL]
        if ends:
            self.handle.registerTimer(min(ends))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self._hold(self._held() | {row["job_id"]: {f: row[f] for f in self.FIELDS} for row in _records(initialState)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        jobs, changed = self._held(), {}
        # all of the micro-batch's events of a job are put in order, however many Arrow batches they come in
        for event in _records(pd.concat(list(rows), ignore_index=True).drop(columns="ts").sort_values(["at", "seq"])):
            job = event["job_id"]
            before = jobs.get(job)
            held = step(before, event)
            if held is not before:
                changed.setdefault(job, before)
                jobs[job] = held
        fresh = {job: jobs[job] for job, before in changed.items() if jobs[job] != before}
        if fresh:
            self._hold(jobs)
            yield pd.DataFrame({"job_id": pd.Series(list(fresh), dtype=object), **{f: pd.Series([held[f] for held in fresh.values()], dtype=object) for f in self.FIELDS}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        clock = timerValues.getCurrentWatermarkInMs()
        self._hold({job: held for job, held in self._held().items() if held["status"] not in states.TERMINAL or self._over_at(held) > clock})
        yield from ()

    def close(self) -> None:
        pass


def _records(rows: pd.DataFrame) -> list[dict]:
    """Rows as dictionaries, with plain integers and None."""
    whole = ("at", "seq", "queue_position", "started", "queued_times")

    def plain(name: str) -> list:
        column = rows[name]
        if column.dtype == "int64":
            return column.tolist()
        values = column.astype(object).where(column.notna(), None).tolist()
        return [None if v is None else int(v) for v in values] if name in whole else values

    return [dict(zip(rows.columns, values)) for values in zip(*map(plain, rows.columns))]


def stream_states(events: DataFrame, lateness: str = "1 day", keep: str = "2 days", known: DataFrame | None = None, buckets: int = states.STREAM_BUCKETS) -> DataFrame:
    """A stream of state changes, to be written in update mode (needs the RocksDB state store).

    As fold_states where events come in order; of events that come after later ones of their job only a
    first terminal state still counts. Events later than lateness do not count. The state of a job that is
    over is dropped when event time is keep past its end, so that no event in time can find it gone. known
    (rows such as fold_states returns, of jobs that exist) is where a new stream starts from. Jobs are held
    in so many buckets by a hash of their ids; a micro-batch writes the buckets that it changes.
    """
    late, held = (pd.Timedelta(t).total_seconds() for t in (lateness, keep))
    if held < late:
        raise ValueError(f"states kept for {keep} would miss events that are {lateness} late")
    rows = _complete(events.withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("ts", lateness)
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int").alias("bucket")
    slim = rows.select("job_id", "status", "at", "seq", "engine_task_id", "queue_position", "ts", bucket)
    start = None
    if known is not None:
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        start = known.select("job_id", "status", micros("updated_at").alias("at"), "seq", "engine_task_id", "queue_position", micros("started_at").alias("started"), "queued_times", bucket).groupBy("bucket")
    return slim.groupBy("bucket").transformWithStateInPandas(StateFold(int(held)), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime", initialState=start)
