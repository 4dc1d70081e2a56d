"""Change feeds and watchdogs as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliomill import states
from foliomill.sources.sinks import compact_table, upsert_table


def follow_changes(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True, keys: list[str] | None = None, version: str = "updated_at", fold_every: int = 32):
    """Adds each micro-batch of changed rows to the table under path. Returns the query.

    With keys, batches are folded together after each fold_every of them, so that a read meets few.

    A micro-batch has the number that Spark gives it, so one that is run again after a failure replaces
    itself; sinks.read_table keeps the last write of each key.
    """

    def keep(batch: DataFrame, number: int) -> None:
        upsert_table(batch, path, number)
        if keys and number % fold_every == fold_every - 1:
            compact_table(batch.sparkSession, path, keys, version)

    writer = changes.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def changes_from(spark: SparkSession, path: str, schema: str, files_at_once: int = 64) -> DataFrame:
    """Changed rows as files arrive under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


class OverdueWatch(StatefulProcessor):
    """X2 for the jobs of one bucket: each is watched from its creation to the limit while the engine has it.

    Jobs that need not be watched stay only until event time is past their row, since older rows come no
    more then. A bucket has one timer, for whichever of its jobs comes first, so Python is called once a
    bucket and not once a job.
    """

    FIELDS = ("id", "updated", "due", "watched")

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("jobs", "id array<string>, updated array<long>, due array<long>, watched array<boolean>")

    def _held(self) -> list[pd.DataFrame]:
        return [pd.DataFrame(dict(zip(self.FIELDS, self.state.get())))] if self.state.exists() else []

    def _told(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["updated"].notna()]
        # a job that need not be watched may have no time of creation
        due = rows["created"].where(rows["watched"], 0).astype("int64") + 1_000_000 * self.limit
        return pd.DataFrame({"id": rows["id"], "updated": rows["updated"].astype("int64"), "due": due, "watched": rows["watched"].astype(bool)})

    def _timers(self, jobs: pd.DataFrame) -> pd.Series:
        # timers know milliseconds: never before the limit
        return (-(-jobs["due"] // 1000)).where(jobs["watched"], jobs["updated"] // 1000 + 1)

    def _hold(self, jobs: pd.DataFrame, clock: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        jobs = jobs[jobs["watched"] | (jobs["updated"] >= 1000 * clock)]
        if jobs.empty:
            self.state.clear()
            return
        self.state.update(tuple(jobs[f].tolist() for f in self.FIELDS))
        self.handle.registerTimer(int(self._timers(jobs).min()))

    def _merge(self, rows: list[pd.DataFrame], clock: int) -> None:
        """Of each job the latest row, of equally late ones the last that came."""
        jobs = pd.concat([*self._held(), *map(self._told, rows)], ignore_index=True)
        self._hold(jobs.sort_values("updated", kind="stable").drop_duplicates("id", keep="last"), clock)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self._merge([initialState], timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._merge(list(rows), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        jobs, clock = self._held()[0], timerValues.getCurrentWatermarkInMs()
        over = jobs["watched"] & (self._timers(jobs) <= clock)
        self._hold(jobs.assign(watched=jobs["watched"] & ~over), clock)
        if over.any():
            yield jobs.loc[over, ["id", "due"]]

    def close(self) -> None:
        pass


def _slim(jobs: DataFrame, buckets: int) -> DataFrame:
    created = F.unix_micros(F.col("created_at").cast("timestamp"))
    watched = F.col("status").isin(*states.CONVERTING) & (F.col("part_count") <= 1) & created.isNotNull()
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    return jobs.select("id", "updated_at", F.unix_micros("updated_at").alias("updated"), created.alias("created"), F.coalesce(watched, F.lit(False)).alias("watched"), bucket.alias("bucket"))


def overdue_stream(jobs: DataFrame, lateness: str = "1 minute", limit: int = states.JOB_TIMEOUT_SECONDS, known: DataFrame | None = None, buckets: int = states.STREAM_BUCKETS) -> DataFrame:
    """X2 over a stream of job rows: (id, due_at) of each unsplit job that the engine still has at the limit.

    The clock is event time, which any job's row moves on, so a job that goes silent is named too. A job
    is named once, unless a later row gives it back to the engine. known (a table with a row for each job)
    is where a new stream starts from. Jobs that need no watching leave the state when event time less
    lateness is past their last row. Jobs are held in so many buckets by a hash of their ids; a micro-batch
    writes the buckets that it meets. Needs the RocksDB state store.
    """
    timed = lambda df: df.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    start = None if known is None else _slim(timed(known), buckets).drop("updated_at").groupBy("bucket")
    rows = _slim(timed(jobs).withWatermark("updated_at", lateness), buckets)
    found = rows.groupBy("bucket").transformWithStateInPandas(OverdueWatch(limit), outputStructType="id string, due long", outputMode="Append", timeMode="EventTime", initialState=start)
    return found.select("id", F.timestamp_micros("due").alias("due_at"))
