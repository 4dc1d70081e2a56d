"""Streams over files give what the batch operators give."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from foliomill.plans.lifecycle_queries import rocksdb
from foliomill.sources import logs, sinks
from foliomill.streaming import alarms, feed, state

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def collected(frame, tmp_path, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name).collect()


def test_overdue_stream_names_jobs_that_go_silent(spark, tmp_path):
    """Each is named once, by the clock of the other jobs' rows."""
    schema = "id string, status string, part_count int, created_at timestamp, updated_at timestamp"
    rows = [
        ("silent", "running", 1, at(0), at(10)), ("split", "running", 3, at(0), at(10)), ("queued", "queued", 1, at(0), at(10)), ("young", "submitted", 1, at(170_000), at(170_000)),
        ("done", "running", 1, at(0), at(10)), ("done", "succeeded", 1, at(0), at(20)), ("chatty", "running", 1, at(0), at(3000)), ("chatty", "running", 1, at(0), at(3010)), ("other", "succeeded", 1, at(0), at(172_000)),
    ]
    for n, some in enumerate((rows[:5], rows[5:])):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"file://{tmp_path}/jobs/{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/jobs")
    with rocksdb(spark):
        found = collected(feed.overdue_stream(stream), tmp_path, "overdue")
    assert sorted((r.id, r.due_at) for r in found) == [("chatty", at(2700)), ("silent", at(2700))]


def test_stream_of_states_equals_batch(spark, tmp_path):
    schema = "job_id string, status string, ts timestamp, seq long, engine_task_id string, queue_position int"
    rows = [("a", "queued", 0), ("a", "submitted", 1), ("a", "running", 2), ("a", "queued", 3), ("b", "submitted", 1), ("b", "running", 5), ("b", "failed", 6), ("b", "queued", 7), ("c", "queued", 1), ("c", "running", 2), ("c", "submitted", 3), ("a", "submitted", 9)]
    events = spark.createDataFrame([(j, s, at(t), t, f"t{t}" if s == "submitted" else None, t) for j, s, t in rows], schema)
    want = {r.job_id: (r.status, r.seq, r.engine_task_id, r.queue_position, r.started_at, r.queued_times) for r in state.fold_states(events).collect()}
    assert want == {"a": ("submitted", 9, "t9", 9, None, 2), "b": ("failed", 6, "t1", 5, at(5), 0), "c": ("submitted", 3, "t3", 3, at(2), 1)}
    for n in range(0, 12, 4):
        events.where(f"seq >= {n} AND seq < {n + 4}").coalesce(1).write.parquet(f"file://{tmp_path}/events/{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/events")
    with rocksdb(spark):
        changes = collected(state.stream_states(stream), tmp_path, "states", "update")
    last = {}
    for r in sorted(changes, key=lambda r: r.seq):
        last[r.job_id] = (r.status, r.seq, r.engine_task_id, r.queue_position, None if r.started is None else at((r.started / 1e6 - START.replace(tzinfo=dt.UTC).timestamp())), r.queued_times)
    assert last == want


def test_tables_of_changes_are_folded(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    frame = lambda rows: spark.createDataFrame(rows, "id string, v int, said string")
    assert sinks.read_table(spark, path, ["id"], "v", "id string, v int, said string").count() == 0
    for number, rows in enumerate([[("a", 1, "x"), ("b", 1, "x")], [("a", 2, "y")], [("b", 0, "late"), ("a", 2, "tie")]]):
        sinks.upsert_table(frame(rows), path, number)
    want = [("a", 2, "tie"), ("b", 1, "x")]
    rows = lambda: sorted(tuple(r) for r in sinks.read_table(spark, path, ["id"], "v").collect())
    assert rows() == want
    sinks.upsert_table(frame([("b", 0, "late"), ("a", 2, "tie")]), path, 2)  # run again after a failure
    sinks.compact_table(spark, path, ["id"], "v")
    assert rows() == want and len(sinks._batches(spark, path)[0]) == 1
    sinks.upsert_table(frame([("c", 1, "new")]), path, 3)
    assert rows() == [*want, ("c", 1, "new")]


def replay(spark, tmp_path, schema, batches):
    """A stream that reads one batch of rows after another."""
    for n, some in enumerate(batches):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
        for f in (tmp_path / f"in/{n}").glob("*.parquet"):
            os.utime(f, (1000 + n, 1000 + n))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def states_left(frame, tmp_path, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name).collect(), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_a_watchdog_starts_from_known_jobs_and_forgets_them(spark, tmp_path):
    schema = "id string, status string, part_count int, created_at timestamp, updated_at timestamp"
    known = spark.createDataFrame([("old", "running", 1, at(0), at(5)), ("over", "succeeded", 1, at(0), at(6)), ("moves", "running", 1, at(0), at(7))], schema)
    day = 86_400
    stream = replay(spark, tmp_path, schema, [[("new", "submitted", 1, at(100), at(100))], [("moves", "succeeded", 1, at(0), at(200))], [("late", "succeeded", 1, at(day), at(day))], [("end", "succeeded", 1, at(2 * day), at(2 * day))], [("end", "failed", 1, at(9 * day), at(9 * day))]])
    with rocksdb(spark):
        found, left = states_left(feed.overdue_stream(stream, known=known), tmp_path, "known", "append")
    assert sorted((r.id, r.due_at) for r in found) == [("new", at(2800)), ("old", at(2700))]
    assert left <= 2  # the job whose row is at the clock, and its timer


def test_a_fold_starts_from_known_states_and_forgets_what_is_over(spark, tmp_path):
    schema = "job_id string, status string, ts timestamp, seq long, engine_task_id string, queue_position int"
    day = 86_400
    before = spark.createDataFrame([("a", "queued", at(0), 1, None, 3), ("b", "failed", at(1), 2, None, None), ("a", "submitted", at(2), 3, "t", 1)], schema)
    batches = [[("a", "running", at(10), 4, None, 0), ("b", "running", at(11), 5, None, 0)], [("a", "succeeded", at(20), 6, None, None)], [("c", "failed", at(10 * day), 7, None, None)], [("c", "failed", at(20 * day), 8, None, None)]]
    stream = replay(spark, tmp_path, schema, batches)
    with rocksdb(spark):
        found, left = states_left(state.stream_states(stream, known=state.fold_states(before)), tmp_path, "folded", "update")
    got = [(r.job_id, r.status, r.engine_task_id, r.queued_times) for r in sorted(found, key=lambda r: r.seq)]
    assert got == [("a", "running", "t", 1), ("a", "succeeded", "t", 1), ("c", "failed", None, 0)]  # b stayed failed
    assert left <= 2
    with pytest.raises(ValueError, match="late"):
        state.stream_states(stream, "3 days", "1 day")


def test_streamed_log_lines(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text('job_submitted job_id=j1 file="a b.pdf" attempt=2\nnoise\n')
    found = collected(logs.stream_logs(spark, f"file://{tmp_path}/logs"), tmp_path, "lines")
    assert sorted((r.event or "", r.job_id, r.file, r.parse_ok) for r in found) == [("", None, None, False), ("job_submitted", "j1", "a b.pdf", True)]


@pytest.mark.parametrize("keyed", [True, False])
def test_exact_alarms_whatever_the_order(spark, tmp_path, keyed):
    """Shuffled micro-batches, no event later than the watermark allows, give what the batch operator gives."""
    rng = random.Random(3)
    rows = [(n, rng.choice("abb"), at(rng.randrange(0, 40_000) / (1 if n % 3 else 7))) for n in range(400)] + [(900 + n, "b", at(s)) for n, s in enumerate((30, 480, 920, 30, 1380, 1381))]
    rows.sort(key=lambda r: (r[2] + dt.timedelta(seconds=rng.randrange(500))))  # at most that much later than those after it
    schema = "event_id long, kind string, ts timestamp"
    end = [(9999, "a", at(100_000))]
    for n, some in enumerate([rows[k : k + 50] for k in range(0, len(rows), 50)] + [end]):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"file://{tmp_path}/events/{n:03}")
        for f in (tmp_path / f"events/{n:03}").glob("*.parquet"):
            os.utime(f, (1000 + n, 1000 + n))  # files are read in order of their times
    key = ["kind"] if keyed else []
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/events")
    with rocksdb(spark):
        found = collected(alarms.stream_rolling_alarm(stream, key, "event_id"), tmp_path, f"exact{keyed}")
    batch = alarms.rolling_alarm(spark.createDataFrame(rows, schema), key).collect()
    assert sorted((int(r.event_id), r.ts, r.recent, r.alarm) for r in found) == sorted((r.event_id, r.ts, r.recent, r.alarm) for r in batch)
    assert {r.alarm for r in batch} == {True, False}


def test_alarms_of_late_events_do_not_come(spark, tmp_path):
    schema = "event_id long, ts timestamp"
    for n, some in enumerate([[(1, at(0)), (2, at(5000))], [(3, at(10)), (4, at(4900))], [(5, at(9000))]]):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"file://{tmp_path}/events/{n}")
        for f in (tmp_path / f"events/{n}").glob("*.parquet"):
            os.utime(f, (1000 + n, 1000 + n))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/events")
    with rocksdb(spark):
        found = collected(alarms.stream_rolling_alarm(stream, [], "event_id"), tmp_path, "late")
    assert sorted((int(r.event_id), r.recent) for r in found) == [(1, 1), (2, 2), (4, 1)]


def test_alarm_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(at(s),) for s in (0, 30, 70, 500, 4000, 9000)], "ts timestamp")
    events.write.parquet(f"file://{tmp_path}/events")
    stream = alarms.stream_alarm(spark.readStream.schema("ts timestamp").parquet(f"file://{tmp_path}/events"))
    got = {(r.start, r.restarts, r.alarm) for r in collected(stream, tmp_path, "alarms", "complete")}
    assert got == {(r.start, r.restarts, r.alarm) for r in alarms.stream_alarm(events).collect()} and any(a for _, _, a in got)


def test_many_jobs_share_few_states(spark, tmp_path):
    """Events of a micro-batch are put in order across Arrow batches, and Python is called for buckets of jobs."""
    schema = "job_id string, status string, ts timestamp, seq long, engine_task_id string, queue_position int"
    n = 25_000  # more than two Arrow batches, the latest events first
    rows = [("hot", "queued" if k % 2 else "running", at(k), k, None, k % 5) for k in range(n, 0, -1)] + [(f"j{k}", "queued", at(k), k, None, 0) for k in range(500)]
    stream = replay(spark, tmp_path, schema, [rows])
    with rocksdb(spark):
        found, left = states_left(state.stream_states(stream, buckets=4), tmp_path, "hot", "update")
    assert len(found) == 501 and left <= 8
    hot = next(r for r in found if r.job_id == "hot")
    assert (hot.status, hot.seq, hot.queued_times) == ("running", n, n // 2)


def test_many_watched_jobs_share_few_states(spark, tmp_path):
    schema = "id string, status string, part_count int, created_at timestamp, updated_at timestamp"
    rows = [(f"w{k}", "running", 1, at(k), at(k)) for k in range(600)] + [("none", "queued", 1, None, at(5))]
    stream = replay(spark, tmp_path, schema, [rows, [("clock", "queued", 1, at(3100), at(3100))]])
    with rocksdb(spark):
        found, left = states_left(feed.overdue_stream(stream, buckets=4), tmp_path, "watched", "append")
    assert sorted(int(r.id[1:]) for r in found) == list(range(341)) and left <= 8  # 2700 s before the clock less a minute


def test_alarms_of_a_frequent_key_are_many_states(spark, tmp_path):
    """A slice of an hour is a state; those whose end is past are gone."""
    schema = "event_id long, kind string, ts timestamp"
    rows = [(k, "a", at(k * 20)) for k in range(4320)]  # one key for a day
    stream = replay(spark, tmp_path, schema, [rows])
    with rocksdb(spark):
        frame = alarms.stream_rolling_alarm(stream, ["kind"], "event_id")
        query = frame.writeStream.format("memory").queryName("slices").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/slices").trigger(availableNow=True).start()
        query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = sorted((int(r.event_id), r.recent) for r in spark.table("slices").collect())
    assert got == [(k, min(k, 45) + 1) for k in range(len(got))] and len(got) == 4289  # up to ten minutes before the last
    assert max(states) >= 24 and states[-1] <= 2 * 2


def test_a_table_of_changes_is_sorted_after_its_shuffle_only(spark, tmp_path):
    """What is read is not sorted in the tasks that read it, whose share grows with the table."""
    path = f"file://{tmp_path}/deals"
    for number in range(2):
        sinks.upsert_table(spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit(number).alias("v")), path, number)
    table = sinks.read_table(spark, path, ["id"], "v")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan[plan.index("Exchange") :]
    assert table.agg(F.count("*"), F.min("v")).first() == (100, 1)
