"""Registered queries over parts, retries, recovery, alarms, streams and whole conversions."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.operators import parts as pt
from foliomill.operators import registry
from foliomill.plans.convert import convert_batch, convert_corpus
from foliomill.plans.derived import Derived, with_tables
from foliomill.plans.text_queries import SLUG
from foliomill.shared import fresh_path
from foliomill.sources import sinks
from foliomill.streaming import alarms, feed, state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-15 00:00:00"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Derived(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_tables(sql)
        return f

    return keep


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def scratch(d: Derived, tag: str) -> str:
    return fresh_path(d.spark, tag)


@query("""
 SELECT content_hash, CAST(n + 1 AS INT) AS ordinal, CAST(1 + 3 * n AS INT) AS first_page, CAST(least(3 + 3 * n, page_count) AS INT) AS last_page
 FROM (SELECT content_hash, page_count, unnest(range(0, (page_count + 2) // 3)) AS n FROM source_document WHERE page_count > 0)""")
def t1_plan_parts(d):
    return pt.plan_parts(d.documents.where("page_count > 0"), 3).select("content_hash", "ordinal", "first_page", "last_page")


@query("""
 , m AS (SELECT *, max(ordinal) OVER (PARTITION BY job_id) AS top, status = 'failed' AND last_page > first_page AS doomed FROM conversion_part)
 , h AS (SELECT job_id, top, split_depth, unnest([first_page, first_page + 1]) AS page FROM m WHERE doomed)
 SELECT job_id, ordinal, first_page, last_page, status, split_depth FROM m WHERE NOT doomed
 UNION ALL SELECT job_id, top + row_number() OVER (PARTITION BY job_id ORDER BY page), page, page, 'queued', split_depth + 1 FROM h""")
def t2_w4_halve_parts(d):
    halved = pt.halve_parts(d.parts, (F.col("status") == "failed") & (F.col("last_page") > F.col("first_page")))
    return halved.select("job_id", "ordinal", "first_page", "last_page", "status", "split_depth")


@query("""
 SELECT job_id, md5(CASE WHEN count(*) FILTER (WHERE status = 'succeeded') > 0 THEN string_agg(CASE WHEN status = 'succeeded' THEN markdown ELSE
   concat('> **Pages ', first_page, '-', last_page, ' are missing from this document.** That part could not be converted, so its content is absent here. Convert those pages separately if you need them.') END,
   chr(10) || chr(10) ORDER BY first_page) || chr(10) END) AS text_md5, count(*) AS part_count FROM conversion_part GROUP BY job_id""")
def t3_join_parts(d):
    return pt.join_parts(d.parts).select("job_id", F.md5("markdown").alias("text_md5"), "part_count")


@query("""
 SELECT job_id, string_agg(concat(first_page, '-', last_page), ',' ORDER BY first_page) FILTER (WHERE status <> 'succeeded') AS missing,
   CASE WHEN count(*) FILTER (WHERE status = 'succeeded') = 0 THEN coalesce(first(failure_reason ORDER BY first_page), 'The document was converted but the result could not be saved, so it was lost. Please convert it again.') END AS failure_reason
 FROM conversion_part GROUP BY job_id""")
def t4_missing_ranges(d):
    found = pt.missing_ranges(d.parts)
    shown = F.array_join(F.transform("missing_page_ranges", lambda r: F.concat(r["first_page"].cast("string"), F.lit("-"), r["last_page"].cast("string"))), ",")
    return found.select("job_id", shown.alias("missing"), "failure_reason")


@query(" SELECT id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY first_page, ordinal) AS INT) AS position FROM conversion_part")
def w2_reading_order(d):
    return pt.reading_order(d.parts).select("id", "position")


@query("""
 , p AS (SELECT job_id, first_page, last_page, coalesce(max(last_page) OVER (PARTITION BY job_id ORDER BY first_page, last_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
         FROM (SELECT job_id, CASE WHEN ordinal % 7 = 3 THEN first_page - 1 ELSE first_page END AS first_page, last_page FROM conversion_part WHERE ordinal % 5 <> 2))
 SELECT job_id, 'gap' AS fault, b + 1 AS from_page, first_page - 1 AS to_page FROM p WHERE first_page > b + 1
 UNION ALL SELECT job_id, 'overlap', first_page, least(b, last_page) FROM p WHERE first_page <= b
 UNION ALL SELECT j.id, 'gap', coalesce(max(p.last_page), 0) + 1, max(j.pages) FROM conversion_job j LEFT JOIN p ON p.job_id = j.id WHERE j.pages > 0 GROUP BY j.id HAVING coalesce(max(p.last_page), 0) < max(j.pages)""")
def w3_coverage(d):
    shifted = d.parts.where("ordinal % 5 <> 2").withColumn("first_page", F.when(F.col("ordinal") % 7 == 3, F.col("first_page") - 1).otherwise(F.col("first_page")))
    return pt.coverage_faults(shifted, d.jobs.where("pages > 0").select(F.col("id").alias("job_id"), "pages"))


@query("""
 , c AS (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE status IN ('succeeded', 'failed', 'timed_out')) AS done FROM conversion_part GROUP BY job_id)
 SELECT id, coalesce(n, part_count) AS part_count, coalesce(done, parts_completed) AS parts_completed FROM conversion_job LEFT JOIN c ON id = job_id""")
def a4_part_counters(d):
    return pt.part_counters(d.jobs, d.parts).select("id", "part_count", "parts_completed")


@query(" SELECT failure_reason, count(*) AS parts FROM conversion_part WHERE failure_reason IS NOT NULL GROUP BY failure_reason")
def a8_gap_reasons(d):
    return pt.gap_reasons(d.parts)


@query(f"""
 SELECT id, 'This document was still converting after 45 minutes and was stopped. It may be very large or unusually complex.' AS failure_reason FROM conversion_job
 WHERE status IN ('submitted', 'running') AND part_count <= 1 AND epoch(TIMESTAMP '{AS_OF}') - floor(epoch(created_at)) >= 2700""")
def x2_overdue_jobs(d):
    return pt.overdue_jobs(d.jobs, as_of()).select("id", "failure_reason")


@query(f"""
 SELECT id, CASE WHEN split_depth < 2 AND last_page > first_page THEN 'halve' ELSE 'give_up' END AS action FROM conversion_part
 WHERE status IN ('submitted', 'running') AND epoch(TIMESTAMP '{AS_OF}') - floor(epoch(coalesce(started_at, created_at))) >= 2700""")
def x3_overdue_parts(d):
    return pt.overdue_parts(d.parts, as_of(), min_pages=1).select("id", "action")


@query("""
 SELECT id, CASE WHEN event = 'lost' AND attempt < 3 THEN 'requeue' WHEN event IS NOT NULL THEN CASE WHEN split_depth < 2 AND last_page - first_page + 1 > 1 THEN 'halve' ELSE 'give_up' END END AS action
 FROM (SELECT *, CASE status WHEN 'submitted' THEN 'lost' WHEN 'failed' THEN 'failed' WHEN 'timed_out' THEN 'timed_out' END AS event FROM conversion_part)""")
def x4_retry_actions(d):
    event = F.when(F.col("status") == "submitted", "lost").when(F.col("status").isin("failed", "timed_out"), F.col("status"))
    return d.parts.select("id", pt.retry_action(event, min_pages=1).alias("action"))


@query("""
 SELECT j.id, CASE WHEN attempt + 1 > 8 OR inbox_path IS NULL THEN 'fail' ELSE 'requeue' END AS action, CASE WHEN attempt + 1 <= 8 AND inbox_path IS NOT NULL THEN attempt + 1 ELSE attempt END AS attempt
 FROM conversion_job j JOIN source_document USING (content_hash) WHERE status IN ('queued', 'submitted', 'running')""")
def x5_recovery_plan(d):
    return pt.recovery_plan(d.jobs, registry.retained_documents(d.documents)).select("id", "action", "attempt")


@query("""
 SELECT id, CASE WHEN inbox_path IS NULL THEN 'fail' ELSE 'requeue' END AS action, CASE WHEN inbox_path IS NULL THEN attempt ELSE attempt + 1 END AS attempt
 FROM conversion_job JOIN source_document USING (content_hash) WHERE status IN ('submitted', 'running') AND event_id % 4 > 0""")
def x5_forgotten_tasks(d):
    """Jobs whose task the engine forgot; it knows those of every fourth event."""
    known = d.jobs.where("event_id % 4 = 0").select("engine_task_id")
    return pt.recovery_plan(pt.forgotten_jobs(d.jobs, known), registry.retained_documents(d.documents), None).select("id", "action", "attempt")


@query("""
 , plan AS (SELECT j.id FROM conversion_job j JOIN source_document USING (content_hash) WHERE status IN ('queued', 'submitted', 'running') AND attempt + 1 <= 8 AND inbox_path IS NOT NULL)
 SELECT p.id, CASE WHEN plan.id IS NOT NULL AND status NOT IN ('succeeded', 'failed', 'timed_out') THEN 'queued' ELSE status END AS status FROM conversion_part p LEFT JOIN plan ON p.job_id = plan.id""")
def x5_requeue_parts(d):
    plan = pt.recovery_plan(d.jobs, registry.retained_documents(d.documents))
    return pt.requeue_unfinished_parts(d.parts, plan).select("id", "status")


@query("""
 , s AS (SELECT job_id, count(*) FILTER (WHERE status IN ('submitted', 'running')) AS flying, bool_and(status IN ('succeeded', 'failed', 'timed_out')) AS done FROM conversion_part GROUP BY job_id)
 SELECT id, CASE WHEN flying > 0 THEN 'submit' ELSE 'finish' END AS repair FROM conversion_job JOIN s ON id = job_id WHERE status = 'queued' AND part_count >= 2 AND (flying > 0 OR done)""")
def x6_inconsistent_jobs(d):
    return pt.inconsistent_jobs(d.jobs, d.parts).select("id", "repair")


@query("""
 SELECT p.id, CASE WHEN inbox_path IS NULL AND p.status = 'queued' THEN 'failed' ELSE p.status END AS status
 FROM conversion_part p JOIN conversion_job j ON j.id = p.job_id JOIN source_document s USING (content_hash)""")
def x9_fail_remainder(d):
    return pt.fail_remainder(d.parts, d.jobs, registry.retained_documents(d.documents)).select("id", "status")


def status_events(d: Derived) -> DataFrame:
    """Every event as a status of the job its user has on that day."""
    kinds = F.array(*[F.lit(s) for s in ("queued", "submitted", "running", "succeeded", "queued", "running", "failed")])
    status = F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int"))
    task = F.when(F.col("event_id") % 7 == 1, F.concat(F.lit("task-"), F.col("event_id").cast("string")))
    return d.table("events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("job_id"), status.alias("status"), "ts", F.col("event_id").alias("seq"),
        task.alias("engine_task_id"), (F.col("event_id") % 5).cast("int").alias("queue_position"),
    )


FOLD = """ , e AS (SELECT concat('u', user_id, '-', strftime(ts, '%Y%m%d')) AS job_id, ['queued', 'submitted', 'running', 'succeeded', 'queued', 'running', 'failed'][event_id % 7 + 1] AS status, ts, event_id AS seq,
     CASE WHEN event_id % 7 = 1 THEN concat('task-', event_id) END AS task, CAST(event_id % 5 AS INT) AS position FROM events)
 , r AS (SELECT *, min(CASE WHEN status IN ('succeeded', 'failed') THEN {'ts': ts, 'seq': seq} END) OVER (PARTITION BY job_id) AS fin FROM e)
 , f AS (SELECT job_id, max({'ts': ts, 'seq': seq, 'v': status}) AS top, max(CASE WHEN status = 'queued' THEN {'ts': ts, 'seq': seq} END) AS q, max(CASE WHEN status = 'submitted' THEN {'ts': ts, 'seq': seq, 'v': task} END) AS t,
     max(CASE WHEN status IN ('submitted', 'running') THEN {'ts': ts, 'seq': seq, 'v': position} END) AS p, max(CASE WHEN status = 'running' THEN {'ts': ts, 'seq': seq} END) AS s, count(*) FILTER (WHERE status = 'queued') AS queued_times
     FROM r WHERE fin IS NULL OR (ts, seq) <= (fin.ts, fin.seq) GROUP BY job_id)
 SELECT job_id, top.v AS status, top.seq AS seq, CASE WHEN q IS NULL OR (t.ts, t.seq) > (q.ts, q.seq) THEN t.v END AS engine_task_id, CASE WHEN q IS NULL OR (p.ts, p.seq) > (q.ts, q.seq) THEN p.v END AS queue_position,
     CASE WHEN q IS NULL OR (s.ts, s.seq) > (q.ts, q.seq) THEN epoch_us(s.ts) END AS started, queued_times FROM f"""
FOLDED = ("job_id", "status", "seq", "engine_task_id", "queue_position", "started", "queued_times")


@query(FOLD)
def x1_fold_states(d):
    return state.fold_states(status_events(d)).withColumn("started", F.unix_micros(F.col("started_at").cast("timestamp"))).select(*FOLDED)


@contextmanager
def rocksdb(spark):
    """The state store that stateful processors need, while a stream runs."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


@query(FOLD)
def x1_fold_states_stream(d):
    """The same as a stream over files, its changes kept by key."""
    spark = d.spark
    source, table, mark = (scratch(d, t) for t in ("events", "states", "mark"))
    events = status_events(d)
    events.write.parquet(source)
    with rocksdb(spark):
        stream = state.stream_states(spark.readStream.schema(events.schema).parquet(source))

        def merge(batch: DataFrame, number: int) -> None:
            sinks.upsert_table(batch.withColumn("batch", F.lit(number)), table, number)

        stream.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return sinks.read_table(spark, table, ["job_id"], "batch", state.OUTPUT + ", batch int").select(*FOLDED)


@query("""
 , j AS (SELECT *, max(updated_at) OVER () AS latest FROM conversion_job)
 SELECT id, epoch_us(created_at) + 2700000000 AS due FROM j
 WHERE status IN ('submitted', 'running') AND part_count <= 1 AND (epoch_us(created_at) + 2700000000 + 999) // 1000 <= epoch_us(latest) // 1000 - 60000""")
def x2_overdue_stream(d):
    """The watchdog as a stream: all rows of jobs arrive, and event time, which the latest row moves on, finds those that went silent."""
    source, table, mark = (scratch(d, t) for t in ("jobs", "overdue", "mark"))
    rows = d.jobs.select("id", "status", "part_count", F.col("created_at").cast("timestamp").alias("created_at"), F.col("updated_at").cast("timestamp").alias("updated_at"))
    rows.write.parquet(source)
    with rocksdb(d.spark):
        stream = feed.overdue_stream(d.spark.readStream.schema(rows.schema).parquet(source))
        stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return d.spark.read.schema(stream.schema).parquet(table).select("id", F.unix_micros("due_at").alias("due"))


@query("""
 SELECT event_id, CAST(count(*) OVER (PARTITION BY event_type ORDER BY floor(epoch(ts)) RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM events""")
def w8_rolling_alarm(d):
    return alarms.rolling_alarm(d.table("events"), ["event_type"]).select("event_id", "recent")


@query("""
 , w AS (SELECT time_bucket(INTERVAL '1' MINUTE, ts) - k * INTERVAL '1' MINUTE AS start FROM events, range(0, 15) AS r(k))
 SELECT epoch(start)::BIGINT AS start, count(*) AS restarts, count(*) >= 3 AS alarm FROM w GROUP BY 1""")
def x7_alarm_windows(d):
    windows = alarms.stream_alarm(d.table("events"))
    return windows.select(F.unix_seconds("start").alias("start"), "restarts", "alarm")


@query("""
 , e AS (SELECT event_id, event_type, ts, count(*) OVER (PARTITION BY event_type ORDER BY floor(epoch(ts)) RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS recent, max(ts) OVER () AS latest FROM events)
 SELECT event_type, CAST(event_id AS VARCHAR) AS event_id, CAST(epoch_us(ts) AS BIGINT) AS at, CAST(recent AS BIGINT) AS recent, recent >= 3 AS alarm FROM e
 WHERE 1000 * (epoch_us(ts) // 1000000 + 1) <= epoch_us(latest) // 1000 - 600000""")
def x7_alarm_stream(d):
    """Every event with its alarm, told by the stream once its second is past."""
    source, table, mark = (scratch(d, t) for t in ("events", "alarms", "mark"))
    rows = d.table("events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows.repartition(8, "event_id").write.parquet(source)
    with rocksdb(d.spark):
        stream = alarms.stream_rolling_alarm(d.spark.readStream.schema(rows.schema).parquet(source), ["event_type"], "event_id")
        stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return d.spark.read.schema(stream.schema).parquet(table).select("event_type", "event_id", F.unix_micros("ts").alias("at"), "recent", "alarm")


@query(" SELECT id, status, updated_at FROM conversion_job")
def x8_change_feed(d):
    """Every job's rows as they change, replayed as a stream into a table that keeps the last of each."""
    jobs = d.jobs.select("id", "status", "updated_at")
    first = jobs.select("id", F.lit("queued").alias("status"), (F.col("updated_at") - F.expr("INTERVAL '1' HOUR")).alias("updated_at"))
    source, table, mark = (scratch(d, t) for t in ("changes", "jobs", "mark"))
    first.write.parquet(source)
    jobs.write.mode("append").parquet(source)
    schema = "id string, status string, updated_at timestamp_ntz"
    # a few micro-batches, each of as many files as it takes, so that no task has a large part of the rows
    files = len(d.spark.read.schema(schema).parquet(source).inputFiles())
    feed.follow_changes(feed.changes_from(d.spark, source, schema, -(-files // 4)), table, mark, keys=["id"], fold_every=2).awaitTermination()
    return sinks.read_table(d.spark, table, ["id"], "updated_at", schema)


@query(f"""
 , p AS (SELECT ['engine_reachable', 'outbox_writable', 'database_writable', 'loop_running', 'last_refusal'][event_id % 5 + 1] AS probe, event_id % 5 < 4 OR value > 1e9 AS value, ts FROM events WHERE ts <= TIMESTAMP '{AS_OF}')
 , l AS (SELECT coalesce(arg_max(value, ts) FILTER (WHERE probe = 'engine_reachable'), false) AS engine_reachable, coalesce(arg_max(value, ts) FILTER (WHERE probe = 'outbox_writable'), false) AS outbox_writable,
     coalesce(arg_max(value, ts) FILTER (WHERE probe = 'database_writable'), false) AS database_writable, coalesce(arg_max(value, ts) FILTER (WHERE probe = 'loop_running'), false) AS loop_running,
     coalesce(arg_max(value, ts) FILTER (WHERE probe = 'last_refusal'), false) AS last_refusal FROM p)
 , r AS (SELECT count(*) AS engine_restarts_recent FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '{AS_OF}' AND floor(epoch(ts)) >= epoch(TIMESTAMP '{AS_OF}') - 900)
 , c AS (SELECT l.*, r.*, (SELECT count(*) FROM conversion_job WHERE status = 'queued') AS queued, (SELECT count(*) FROM conversion_job WHERE status IN ('submitted', 'running')) AS converting,
     (SELECT count(*) FROM markdown_output) AS documents, last_refusal OR engine_restarts_recent >= 3 OR NOT loop_running AS stalled FROM l, r)
 SELECT *, CASE WHEN engine_reachable AND outbox_writable AND database_writable AND NOT stalled THEN 'ok' ELSE 'degraded' END AS status FROM c""")
def a13_operational_status(d):
    e = d.table("events")
    probes = F.array(*[F.lit(p) for p in ("engine_reachable", "outbox_writable", "database_writable", "loop_running", "last_refusal")])
    probe = F.element_at(probes, (F.col("event_id") % 5 + 1).cast("int"))
    seen = e.select(probe.alias("probe"), ((F.col("event_id") % 5 < 4) | (F.col("value") > 1e9)).alias("value"), "ts")
    return alarms.operational_status(seen, d.jobs, e.where("event_type = 'error'").select("ts"), d.outputs, as_of())


def page_converter(batch: pd.DataFrame) -> list[tuple[str | None, str, list[str]]]:
    """A converter that fails on parts of more than two pages that hold a page divisible by five."""
    out = []
    for job, a, b in zip(batch["job_id"], batch["first_page"], batch["last_page"]):
        bad = b - a + 1 > 2 and any(p % 5 == 0 for p in range(a, b + 1))
        out.append((None, "failure", ["memory"]) if bad else ("\n".join(f"{job} page {p}" for p in range(a, b + 1)), "success", []))
    return out


@query("""
 SELECT id AS job_id, 'succeeded' AS status, string_agg(concat(id, ' page ', p), chr(10) ORDER BY p) AS flat FROM (SELECT id, unnest(range(1, pages * 4 + 1)) AS p FROM conversion_job WHERE pages > 0) GROUP BY id""")
def c1_convert_corpus(d):
    """All jobs through a converter that needs halving, their pages joined again in order."""
    todo = d.jobs.where("pages > 0").select("id", "content_hash", (F.col("pages") * 4).alias("page_count"))
    done = convert_corpus(todo, page_converter, max_pages=8, max_depth=3, min_pages=1)
    plain = F.when(F.col("status").isin("succeeded", "succeeded_suspect"), "succeeded").otherwise(F.col("status"))
    return done.select("job_id", plain.alias("status"), F.regexp_replace(F.rtrim(F.regexp_replace("markdown", r"\n+", "\n")), r"\n$", "").alias("flat"))


def line_converter(batch: pd.DataFrame) -> list[tuple[str | None, str, list[str]]]:
    """A converter that knows each page's line, and says of parts that begin on an even page that they are only partial."""
    return [("\n".join(f"{h} page {p}" for p in range(a, b + 1)), "partial_success" if a % 2 == 0 else "success", []) for h, a, b in zip(batch["content_hash"], batch["first_page"], batch["last_page"])]


@query(f"""
 , latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY written_at DESC, section_ordinal NULLS FIRST, output_filename) AS n FROM markdown_output) WHERE n = 1)
 , lost AS (SELECT DISTINCT content_hash FROM markdown_output WHERE bytes > 4000)
 , claim AS (SELECT j.id, l.output_filename FROM conversion_job j JOIN latest l USING (content_hash) LEFT JOIN lost USING (content_hash) LEFT JOIN conversion_job p ON p.id = l.job_id
     WHERE j.status = 'queued' AND lost.content_hash IS NULL AND coalesce(p.status, '') <> 'succeeded_incomplete')
 , todo AS (SELECT content_hash, max(j.id) AS id FROM conversion_job j LEFT JOIN claim USING (id) WHERE j.status = 'queued' AND claim.id IS NULL GROUP BY content_hash)
 , made AS (SELECT t.content_hash, t.id, concat({SLUG.format("j.submitted_filename", 80, "document")}, '--', substr(t.content_hash, 1, 12), '.md') AS name, greatest(j.pages, 1) AS pages FROM todo t JOIN conversion_job j ON j.id = t.id)
 SELECT 'claimed' AS kind, id AS key, output_filename AS name, CAST(NULL AS BIGINT) AS n FROM claim
 UNION ALL SELECT 'converted', id, CASE WHEN pages >= 4 THEN 'partial' ELSE 'whole' END, (pages + 2) // 3 FROM made
 UNION ALL SELECT 'stored', content_hash, name, 71 * pages + CAST(list_sum(list_transform(range(1, pages + 1), lambda x: length(CAST(x AS VARCHAR)))) AS BIGINT) + (pages + 2) // 3 - 1 FROM made
 UNION ALL SELECT 'superseded', content_hash, o.output_filename, NULL FROM markdown_output o JOIN made USING (content_hash) WHERE o.output_filename <> made.name""")
def c1_convert_batch(d):
    """C1 whole over the queued jobs: claim, convert, plan, supersede and store."""
    queued = d.jobs.where("status = 'queued'").select("id", "content_hash", "submitted_filename", F.col("pages").alias("page_count"))
    path = scratch(d, "outbox")
    done = convert_batch(queued, d.outputs, d.outputs.where("bytes <= 4000").select("output_filename"), d.jobs.select("id", "status", "missing_page_ranges"), line_converter, path, require_all=True, max_pages=3)
    stored = sinks.read_outputs(d.spark, path, done["files"].schema)
    none = F.lit(None).cast("long").alias("n")
    rows = done["claimed"].select(F.lit("claimed").alias("kind"), F.col("id").alias("key"), F.col("claimed_output").alias("name"), none)
    rows = rows.unionByName(done["converted"].select(F.lit("converted").alias("kind"), F.col("job_id").alias("key"), F.when(F.col("any_partial"), "partial").otherwise("whole").alias("name"), F.col("part_count").cast("long").alias("n")))
    rows = rows.unionByName(stored.select(F.lit("stored").alias("kind"), F.col("content_hash").alias("key"), F.col("output_filename").alias("name"), F.length("text").cast("long").alias("n")))
    return rows.unionByName(done["superseded"].select(F.lit("superseded").alias("kind"), F.col("content_hash").alias("key"), F.col("output_filename").alias("name"), none))


@query("""
 SELECT content_hash, output_filename FROM markdown_output WHERE section_ordinal IS NULL OR content_hash NOT IN (SELECT content_hash FROM source_document WHERE first_doc % 2 = 0)
 UNION SELECT content_hash, concat('new--', substr(content_hash, 1, 12), '.md') FROM source_document WHERE first_doc % 2 = 0
 EXCEPT SELECT content_hash, output_filename FROM markdown_output WHERE content_hash IN (SELECT content_hash FROM source_document WHERE first_doc % 2 = 0)""")
def s7_replace_outputs(d):
    path = scratch(d, "outbox")
    texts = lambda df: df.select("content_hash", "output_filename", F.col("output_filename").alias("text"))
    sinks.replace_outputs(texts(d.outputs), path)
    fresh = d.documents.where("first_doc % 2 = 0").select("content_hash", F.concat(F.lit("new--"), F.substring("content_hash", 1, 12), F.lit(".md")).alias("output_filename"))
    sinks.replace_outputs(texts(fresh), path)
    return sinks.read_outputs(d.spark, path, texts(fresh).schema).select("content_hash", "output_filename")


@query(" SELECT id, status, 'second' AS source FROM conversion_job WHERE event_id % 2 = 0 UNION ALL SELECT id, status, 'first' FROM conversion_job WHERE event_id % 2 = 1")
def s8_upsert(d):
    first = d.jobs.select("id", "status", F.lit("first").alias("source"), "updated_at")
    second = d.jobs.where("event_id % 2 = 0").select("id", "status", F.lit("second").alias("source"), (F.col("updated_at") + F.expr("INTERVAL '1' SECOND")).alias("updated_at"))
    return sinks.upsert(first, second, ["id"], "updated_at").drop("updated_at")
