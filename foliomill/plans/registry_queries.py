"""Registered queries over the registry, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill import schemas
from foliomill.functions import status as st
from foliomill.operators import intake, registry, retention
from foliomill.plans.derived import AS_OF, Derived, with_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SINCE = "2024-01-10 00:00:00"


def query(sql: str | None = None):
    """Registers a function of the derived tables under its name."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Derived(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_tables(sql)
        return f

    return keep


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def present(d: Derived) -> DataFrame:
    """Outputs whose file is there: those of at most 4000 bytes."""
    return d.outputs.where("bytes <= 4000").select("output_filename")


PRESENT = "(SELECT output_filename FROM markdown_output WHERE bytes <= 4000)"


@query(" SELECT id, 1 AS part_count, 0 AS parts_completed, attempt, CAST(NULL AS VARCHAR) AS engine_task_id FROM conversion_job")
def s3_conform(d):
    old = d.jobs.drop("part_count", "parts_completed", "engine_task_id", "missing_page_ranges", "pages", "event_id")
    return schemas.conform(old, "conversion_job").select("id", "part_count", "parts_completed", "attempt", "engine_task_id")


@query(f" SELECT id, status FROM conversion_job WHERE status IN ('failed', 'timed_out') AND updated_at > TIMESTAMP '{SINCE}'")
def p5_job_list(d):
    return registry.list_jobs(d.jobs, status=["failed", "timed_out"], since=ntz(SINCE)).select("id", "status")


@query(" SELECT id, status FROM conversion_job WHERE status IN ('queued', 'submitted', 'running')")
def p6_in_flight(d):
    return registry.in_flight_jobs(d.jobs).select("id", "status")


@query(" SELECT content_hash FROM source_document WHERE inbox_path IS NOT NULL")
def p6_retained_documents(d):
    return registry.retained_documents(d.documents).select("content_hash")


@query(" SELECT max(updated_at) AS marker FROM conversion_job")
def p7_change_marker(d):
    return registry.change_marker(d.jobs)


@query(" SELECT job_id, ordinal, first_page, last_page, status, attempt, split_depth FROM conversion_part")
def p8_part_states(d):
    return registry.part_states(d.parts).select("job_id", "ordinal", "first_page", "last_page", "status", "attempt", "split_depth")


@query("""
 SELECT id, CASE WHEN status IN ('submitted', 'running') AND part_count > 1 THEN concat('Converting — part ', least(parts_completed + 1, part_count), ' of ', part_count)
   WHEN status = 'queued' AND part_count > 1 AND parts_completed > 0 THEN concat('Queued — ', parts_completed, ' of ', part_count, ' parts already converted')
   WHEN status = 'succeeded_incomplete' THEN 'Converted — pages 1-2, 5 are missing'
   ELSE CASE status WHEN 'queued' THEN 'Queued' WHEN 'submitted' THEN 'Converting' WHEN 'running' THEN 'Converting' WHEN 'succeeded' THEN 'Converted'
     WHEN 'succeeded_suspect' THEN 'Converted — check output' WHEN 'already_converted' THEN 'Already converted' WHEN 'failed' THEN 'Failed' ELSE 'Timed out' END END AS shown
 FROM conversion_job""")
def p9_display_status(d):
    return d.jobs.select("id", st.display_status(F.col("status"), F.col("part_count"), F.col("parts_completed"), F.col("missing_page_ranges")).alias("shown"))


@query("""
 SELECT doc_id, CASE WHEN lower(text) LIKE '%password%' OR lower(text) LIKE '%encrypt%' OR lower(text) LIKE '%decrypt%' THEN 0
   WHEN lower(text) LIKE '%timeout%' OR lower(text) LIKE '%timed out%' OR lower(text) LIKE '%deadline%' THEN 1
   WHEN lower(text) LIKE '%too many pages%' OR lower(text) LIKE '%max_num_pages%' OR lower(text) LIKE '%file size%' OR lower(text) LIKE '%too large%' THEN 2
   WHEN lower(text) LIKE '%not valid%' OR lower(text) LIKE '%not allowed%' OR lower(text) LIKE '%policy%' THEN 3
   WHEN regexp_matches(lower(text), 'pdfium|corrupt|damaged|malformed|eof|parse|invalid pdf|cannot read') THEN 4
   WHEN regexp_matches(lower(text), 'memory|oom|resource') THEN 5
   WHEN regexp_matches(lower(text), 'unsupported|skipped|not supported') THEN 6 ELSE 7 END AS kind FROM documents""")
def p10_failure_reason(d):
    messages = [m for _, m in st.FAILURES] + [st.GENERIC_FAILURE]
    reason = st.failure_reason(F.array("text"), F.lit(None).cast("string"))
    return d.table("documents").select("doc_id", (F.array_position(F.array(*[F.lit(m) for m in messages]), reason) - 1).cast("int").alias("kind"))


@query("""
 SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'submitted' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE CASE WHEN event_id % 3 < 2 THEN 'succeeded' ELSE 'failed' END END AS state FROM events""")
def p11_job_state(d):
    task = F.element_at(F.array(*[F.lit(x) for x in ("pending", "started", "failure", "success")]), (F.col("event_id") % 4 + 1).cast("int"))
    engine = F.element_at(F.array(*[F.lit(x) for x in ("success", "partial_success", "skipped")]), (F.col("event_id") % 3 + 1).cast("int"))
    return d.table("events").select("event_id", st.job_state(task, engine).alias("state"))


@query("""
 SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'succeeded_incomplete' WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < ((n_chars + 1799) // 1800 + 20) * 50 THEN 'succeeded_suspect' ELSE 'succeeded' END AS outcome
 FROM documents""")
def p12_outcome(d):
    docs = d.table("documents")
    ranges = F.when(F.col("doc_id") % 5 == 0, F.array(F.struct(F.lit(1).alias("first_page"), F.lit(1).alias("last_page"))))
    pages = F.expr("(n_chars + 1799) div 1800 + 20")
    return docs.select("doc_id", st.outcome(st.is_suspect(F.col("text"), pages), ranges).alias("outcome"))


@query(" SELECT id, CASE WHEN started_at IS NOT NULL AND ended_at IS NOT NULL THEN round(epoch_ms(ended_at) / 1000.0 - epoch_ms(started_at) / 1000.0, 1) END AS seconds FROM conversion_job")
def p13_processing_seconds(d):
    return d.jobs.select("id", st.seconds_between(F.col("started_at"), F.col("ended_at")).alias("seconds"))


@query(" SELECT id, CASE WHEN part_count > 1 OR pages > 40 THEN 'split' ELSE 'whole' END AS division FROM conversion_job")
def p14_division(d):
    return d.jobs.select("id", intake.division(F.col("pages"), F.col("part_count")).alias("division"))


@query(f"""
 SELECT concat('retry-', j.id) AS id, batch_id, content_hash, submitted_filename, 'queued' AS status, TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' AS updated_at, 1 AS attempt
 FROM conversion_job j JOIN source_document USING (content_hash) WHERE status IN ('failed', 'timed_out', 'succeeded_incomplete') AND inbox_path IS NOT NULL""")
def p15_retried_jobs(d):
    return registry.retried_jobs(registry.retry_eligibility(d.jobs, registry.retained_documents(d.documents)), ntz(AS_OF))


@query("""
 SELECT j.id, CASE WHEN status IN ('queued', 'submitted', 'running') THEN 'still_converting' WHEN status IN ('succeeded', 'succeeded_suspect', 'already_converted') THEN 'already_converted'
   WHEN inbox_path IS NULL THEN 'upload_gone' ELSE 'eligible' END AS retry FROM conversion_job j JOIN source_document USING (content_hash)""")
def p15_retry_eligibility(d):
    return registry.retry_eligibility(d.jobs, registry.retained_documents(d.documents)).select("id", "retry")


@query(f"""
 SELECT id, CASE WHEN status IN ('queued', 'submitted', 'running') THEN 'still_converting' WHEN output_filename IS NULL THEN 'no_output'
   WHEN output_filename IN {PRESENT} THEN 'available' ELSE 'output_removed' END AS availability FROM conversion_job""")
def p16_availability(d):
    return registry.output_availability(d.jobs, present(d)).select("id", "availability")


@query("""
 SELECT doc_id, CASE WHEN b >= 1048576 THEN concat(CAST(round_even(b / 1048576.0, 0) AS BIGINT), ' MB') WHEN b >= 1024 THEN concat(CAST(round_even(b / 1024.0, 0) AS BIGINT), ' KB') ELSE concat(b, ' bytes') END AS plain,
   CASE WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN concat(CAST(floor(b / 1024.0 + 0.5) AS BIGINT), ' KB') ELSE concat(b, ' bytes') END AS decimal_size
 FROM (SELECT doc_id, n_chars * n_chars AS b FROM documents)""")
def p20_readable_sizes(d):
    b = F.col("n_chars") * F.col("n_chars")
    return d.table("documents").select("doc_id", st.size_plain(b).alias("plain"), st.size_decimal(b).alias("decimal_size"))


@query(" SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events")
def p21_timestamps(d):
    return d.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"))


@query(" SELECT id, CASE WHEN status = 'succeeded_incomplete' THEN '1-2, 5' END AS ranges, CASE WHEN status = 'succeeded_incomplete' THEN '[[1,2],[5,5]]' END AS encoded FROM conversion_job")
def p22_p24_page_ranges(d):
    ranges = F.col("missing_page_ranges")
    return d.jobs.select("id", st.page_ranges(ranges).alias("ranges"), st.encode_ranges(st.decode_ranges(st.encode_ranges(ranges))).alias("encoded"))


@query("""
 SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id % 50 + 1 WHEN doc_id % 4 = 1 THEN n_chars WHEN doc_id % 4 = 2 AND n_chars > 100 THEN 7 END AS pages FROM documents""")
def p23_page_count(d):
    n, c = F.col("doc_id"), F.col("n_chars").cast("string")
    body = (
        F.when(n % 4 == 0, F.concat(F.lit('{"document":{"page_count":'), (n % 50 + 1).cast("string"), F.lit('},"pages":99}')))
        .when(n % 4 == 1, F.concat(F.lit('{"document":{"page_count":0,"num_pages":"x"},"num_pages":'), c, F.lit("}")))
        .when((n % 4 == 2) & (F.col("n_chars") > 100), F.lit('{"document":{"pages":-3},"pages":7}'))
        .otherwise(F.lit('{"document":{}}'))
    )
    return d.table("documents").select("doc_id", st.page_count_of(body).alias("pages"))


@query("""
 SELECT id, CASE WHEN failure_reason IS NOT NULL THEN failure_reason WHEN status = 'succeeded_suspect' THEN 'The Markdown came out almost empty. Open it before importing it.'
   WHEN status = 'succeeded_incomplete' THEN 'Converted, but pages 1–2, 5 are missing — those parts failed.'
   WHEN status = 'already_converted' THEN 'This document was already converted earlier; the Markdown is in the output folder.' ELSE 'Converted.' END AS said FROM conversion_job""")
def p25_explanation(d):
    return d.jobs.select("id", st.explanation(F.col("failure_reason"), F.col("status"), F.lit("success"), F.col("missing_page_ranges")).alias("said"))


@query("""
 SELECT j.id, j.status, s.original_filename, s.size_bytes, o.bytes AS output_bytes, o.engine_status
 FROM conversion_job j JOIN source_document s USING (content_hash) LEFT JOIN markdown_output o ON j.output_filename = o.output_filename""")
def j1_job_view(d):
    return registry.job_view(d.jobs, d.documents, d.outputs).select("id", "status", "original_filename", "size_bytes", "output_bytes", "engine_status")


@query(f"""
 , latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY written_at DESC, section_ordinal NULLS FIRST, output_filename) AS n FROM markdown_output) WHERE n = 1)
 SELECT j.id, l.output_filename AS claimed_output FROM conversion_job j JOIN latest l USING (content_hash)
 LEFT JOIN conversion_job p ON p.id = l.job_id
 WHERE j.status = 'queued' AND l.bytes <= 4000 AND coalesce(p.status, '') <> 'succeeded_incomplete'""")
def j2_already_converted(d):
    return registry.already_converted(d.jobs.where("status = 'queued'"), d.outputs, present(d), d.jobs).select("id", "claimed_output")


@query("""
 , latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY written_at DESC, section_ordinal NULLS FIRST, output_filename) AS n FROM markdown_output) WHERE n = 1)
 , lost AS (SELECT DISTINCT content_hash, job_id FROM markdown_output WHERE bytes > 4000)
 SELECT j.id, l.output_filename AS claimed_output FROM conversion_job j JOIN latest l USING (content_hash) LEFT JOIN lost ON lost.content_hash = l.content_hash AND lost.job_id = l.job_id LEFT JOIN conversion_job p ON p.id = l.job_id
 WHERE j.status = 'queued' AND lost.job_id IS NULL AND coalesce(p.status, '') <> 'succeeded_incomplete'""")
def j2_whole_set_converted(d):
    """As j2_already_converted, but every section of the latest run must be present."""
    return registry.already_converted(d.jobs.where("status = 'queued'"), d.outputs, present(d), d.jobs, require_all=True).select("id", "claimed_output")


@query("""
 SELECT j.id, count(o.output_filename) FILTER (WHERE o.job_id = j.id) AS own, count(o.output_filename) AS every,
   coalesce(string_agg(o.output_filename, ',' ORDER BY coalesce(o.section_ordinal, 0), o.output_filename), '') AS names
 FROM conversion_job j LEFT JOIN markdown_output o USING (content_hash) GROUP BY j.id""")
def j3_output_details(d):
    """Every job with how many outputs it wrote, how many its document has, and their names in section order."""
    places = F.array_sort(F.collect_list(F.struct("position", "output_filename")))
    lists = registry.document_outputs(d.outputs).groupBy("content_hash").agg(F.transform(places, lambda o: o["output_filename"]).alias("every"))
    told = registry.output_details(d.jobs, d.outputs).join(lists, "content_hash", "left")
    every = F.coalesce("every", F.array().cast("array<string>"))
    return told.select("id", F.size("positions").cast("long").alias("own"), F.size(every).cast("long").alias("every"), F.array_join(every, ",").alias("names"))


@query("""
 , g AS (SELECT id FROM conversion_job WHERE part_count >= 2 AND status = 'succeeded_incomplete')
 SELECT p.job_id, p.first_page, p.last_page, p.status, p.attempt AS attempts, p.failure_reason FROM conversion_part p JOIN g ON g.id = p.job_id WHERE p.status <> 'succeeded'""")
def j4_missing_parts(d):
    return registry.missing_parts(d.jobs, d.parts)


@query("""
 SELECT content_hash, CASE WHEN content_hash IN (SELECT content_hash FROM conversion_job WHERE status IN ('submitted', 'running')) THEN 'skipped' ELSE 'deleted' END AS action FROM source_document""")
def j6_deletion_plan(d):
    return retention.deletion_plan(d.documents, d.jobs).select("content_hash", "action")


@query("""
 , doomed AS (SELECT content_hash FROM source_document WHERE content_hash NOT IN (SELECT content_hash FROM conversion_job WHERE status IN ('submitted', 'running')))
 SELECT 'conversion_job' AS tab, id AS key FROM conversion_job WHERE content_hash NOT IN (SELECT content_hash FROM doomed)
 UNION ALL SELECT 'conversion_part', id FROM conversion_part WHERE job_id NOT IN (SELECT id FROM conversion_job WHERE content_hash IN (SELECT content_hash FROM doomed))
 UNION ALL SELECT 'markdown_output', output_filename FROM markdown_output WHERE content_hash NOT IN (SELECT content_hash FROM doomed)
 UNION ALL SELECT 'source_document', content_hash FROM source_document WHERE content_hash NOT IN (SELECT content_hash FROM doomed)
 UNION ALL SELECT DISTINCT 'batch', batch_id FROM conversion_job""")
def j6_delete_documents(d):
    """Every row that stays."""
    plan = retention.deletion_plan(d.documents, d.jobs)
    left = retention.delete_documents(plan, d.jobs.select("batch_id").distinct(), d.documents, d.jobs, d.parts, d.outputs)
    keys = {"batch": "batch_id", "conversion_job": "id", "conversion_part": "id", "markdown_output": "output_filename", "source_document": "content_hash"}
    return reduce(DataFrame.unionByName, [left[t].select(F.lit(t).alias("tab"), F.col(k).alias("key")) for t, k in keys.items()])


@query(" SELECT content_hash FROM source_document WHERE content_hash IN (SELECT content_hash FROM conversion_job WHERE status IN ('submitted', 'running'))")
def j7_busy_documents(d):
    return registry.busy_documents(d.jobs, d.documents).select("content_hash")


@query(" SELECT j.id, s.inbox_path IS NOT NULL AS has_upload FROM conversion_job j JOIN source_document s USING (content_hash)")
def j8_upload_presence(d):
    return registry.with_upload(d.jobs, registry.retained_documents(d.documents)).select("id", "has_upload")


@query("""
 , j AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'lost' ELSE status END AS st, CASE WHEN event_id % 89 = 0 THEN 'nowhere' ELSE content_hash END AS h FROM conversion_job)
 SELECT 'job without document' AS rule, id AS key FROM j WHERE h = 'nowhere'
 UNION ALL SELECT 'unknown job status', id FROM j WHERE st = 'lost'
 UNION ALL SELECT 'part without job', id FROM conversion_part WHERE job_id NOT IN (SELECT id FROM conversion_job)
 UNION ALL SELECT 'upload without jobs', content_hash FROM source_document WHERE inbox_path IS NOT NULL AND content_hash NOT IN (SELECT h FROM j)
 UNION ALL SELECT 'repeated output', output_filename FROM markdown_output GROUP BY 2 HAVING count(*) > 1""")
def j10_integrity(d):
    jobs = d.jobs.withColumn("status", F.when(F.col("event_id") % 97 == 0, "lost").otherwise(F.col("status"))).withColumn("content_hash", F.when(F.col("event_id") % 89 == 0, "nowhere").otherwise(F.col("content_hash")))
    batches = d.jobs.select(F.col("batch_id").alias("id")).distinct()
    return retention.integrity_violations(batches, d.documents, jobs, d.parts, d.outputs)


@query(" SELECT count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status IN ('submitted', 'running')) AS converting FROM conversion_job")
def a1_backlog(d):
    return registry.backlog(d.jobs)


@query("""
 SELECT batch_id, count(*) FILTER (WHERE status IN ('failed', 'timed_out')) AS failed,
   count(*) FILTER (WHERE status IN ('succeeded', 'succeeded_suspect', 'succeeded_incomplete', 'already_converted')) AS done,
   count(*) FILTER (WHERE status = 'queued') AS waiting, count(*) FILTER (WHERE status IN ('submitted', 'running')) AS converting, count(*) AS total,
   count(*) FILTER (WHERE status NOT IN ('queued', 'submitted', 'running')) = count(*) AS finished
 FROM conversion_job GROUP BY batch_id""")
def a2_batch_progress(d):
    return registry.batch_progress(d.jobs)


@query(" SELECT batch_id, status, count(*) AS jobs FROM conversion_job GROUP BY ALL")
def a2_batch_states(d):
    return registry.batch_states(d.jobs)


@query(" SELECT count(*) FILTER (WHERE status IN ('submitted', 'running')) AS active FROM conversion_job")
def a3_active_count(d):
    return registry.active_count(d.jobs)


@query(" SELECT job_id, count(*) FILTER (WHERE status IN ('submitted', 'running')) AS in_flight FROM conversion_part GROUP BY job_id")
def a3_parts_in_flight(d):
    return registry.parts_in_flight(d.parts)


@query(" SELECT count(*) AS outputs FROM markdown_output")
def a3_output_count(d):
    return registry.output_count(d.outputs)


@query("""
 SELECT content_hash, first(filename ORDER BY seq) AS original_filename, first(size_bytes ORDER BY seq) AS size_bytes, last(page_count ORDER BY seq) FILTER (WHERE page_count IS NOT NULL) AS page_count,
   last(inbox_path ORDER BY seq) FILTER (WHERE inbox_path IS NOT NULL) AS inbox_path
 FROM (SELECT content_hash, submitted_filename AS filename, event_id AS seq, event_id % 1000 AS size_bytes, CASE WHEN event_id % 4 > 0 THEN pages END AS page_count, CASE WHEN event_id % 3 > 0 THEN concat('/in/', event_id) END AS inbox_path FROM conversion_job)
 GROUP BY content_hash""")
def a5_converge_documents(d):
    uploads = d.jobs.select("content_hash", F.col("submitted_filename").alias("filename"), F.col("event_id").alias("seq"), (F.col("event_id") % 1000).alias("size_bytes"), F.when(F.col("event_id") % 4 > 0, F.col("pages")).alias("page_count"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("/in/"), F.col("event_id").cast("string"))).alias("inbox_path"), F.col("created_at").alias("seen_at"))
    return intake.converge_documents(uploads).drop("first_seen_at")


@query("""
 SELECT content_hash, output_filename, job_id FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY written_at DESC, section_ordinal NULLS FIRST, output_filename) AS n FROM markdown_output) WHERE n = 1""")
def a6_latest_output(d):
    return registry.latest_output(d.outputs).select("content_hash", "output_filename", "job_id")


def batch_uploads(d):
    sizes = d.documents.select("content_hash", "size_bytes")
    return d.jobs.join(sizes, "content_hash").select("batch_id", F.col("submitted_filename").alias("filename"), F.when(F.col("size_bytes") % 4 == 0, F.lit("refused")).alias("reason"))


@query("""
 SELECT batch_id, count(*) FILTER (WHERE size_bytes % 4 > 0) AS document_count, count(*) FILTER (WHERE size_bytes % 4 = 0) AS rejected_count
 FROM conversion_job JOIN source_document USING (content_hash) GROUP BY batch_id""")
def a7_batch_intake(d):
    return intake.batch_intake(batch_uploads(d))


@query("""
 SELECT batch_id, submitted_filename AS filename, size_bytes % 4 > 0 AS accepted, CASE WHEN size_bytes % 4 = 0 THEN 'refused' END AS reason FROM conversion_job JOIN source_document USING (content_hash)""")
def a7_intake_files(d):
    return intake.intake_files(batch_uploads(d))


@query(" SELECT count(*) AS entries, count(DISTINCT content_hash) AS documents, count(output_filename) AS with_output FROM conversion_job")
def a9_impact(d):
    return registry.impact(d.jobs)


@query(f"""
 , doomed AS (SELECT content_hash FROM source_document WHERE content_hash NOT IN (SELECT content_hash FROM conversion_job WHERE status IN ('submitted', 'running')))
 SELECT (SELECT count(*) FROM doomed) AS documents, (SELECT count(*) FROM conversion_job WHERE content_hash IN (SELECT content_hash FROM doomed)) AS jobs,
   (SELECT count(*) FROM markdown_output WHERE content_hash IN (SELECT content_hash FROM doomed) AND output_filename IN {PRESENT}) AS removed,
   (SELECT count(*) FROM markdown_output WHERE content_hash IN (SELECT content_hash FROM doomed) AND output_filename NOT IN {PRESENT}) AS kept,
   (SELECT count(*) FROM source_document) - (SELECT count(*) FROM doomed) AS skipped""")
def a12_deletion_summary(d):
    return retention.deletion_summary(retention.deletion_plan(d.documents, d.jobs), d.jobs, d.outputs, present(d))


@query(" SELECT job_id, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM markdown_output GROUP BY job_id")
def a14_output_totals(d):
    return registry.output_totals(d.outputs)


@query(" SELECT id, created_at FROM conversion_job ORDER BY created_at DESC, id LIMIT 100")
def l1_recent_jobs(d):
    return registry.recent_jobs(d.jobs).select("id", "created_at")


@query(" SELECT output_filename, written_at FROM markdown_output ORDER BY written_at DESC, output_filename LIMIT 500")
def l2_output_inventory(d):
    return registry.output_inventory(d.outputs).select("output_filename", "written_at")


@query(" SELECT content_hash, first_seen_at FROM source_document")
def l2_document_inventory(d):
    return registry.document_inventory(d.documents)


@query(" SELECT id FROM conversion_job WHERE status = 'succeeded_incomplete' ORDER BY created_at DESC, id LIMIT 1")
def l3_job_to_explain(d):
    return registry.job_to_explain(d.jobs).select("id")


@query("""
 SELECT id, CAST(place AS BIGINT) AS place FROM (SELECT id, row_number() OVER (ORDER BY created_at, id) AS place FROM conversion_job WHERE status = 'queued')
 WHERE place <= 5000 - (SELECT count(*) FROM conversion_job WHERE status IN ('submitted', 'running')) AND place <= 5000""")
def w1_admitted_jobs(d):
    return registry.admitted_jobs(d.jobs, 5_000).select("id", F.col("place").cast("long").alias("place"))


@query("""
 SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN status = 'queued' THEN 0 ELSE 1 END, first_page, ordinal) AS place,
   count(*) FILTER (WHERE status IN ('submitted', 'running')) OVER (PARTITION BY job_id) AS busy FROM conversion_part) WHERE status = 'queued' AND place <= 2 - busy""")
def w1_admitted_parts(d):
    return registry.admitted_parts(d.parts).select("id")


@query(f"""
 , s AS (SELECT content_hash, bool_or(status IN ('queued', 'submitted', 'running')) AS flying, max(ended_at) FILTER (WHERE status IN ('succeeded', 'succeeded_suspect', 'succeeded_incomplete', 'already_converted')) AS good,
     max(ended_at) FILTER (WHERE status IN ('failed', 'timed_out')) AS bad FROM conversion_job GROUP BY 1)
 SELECT content_hash, coalesce(good, bad) AS ended_at FROM s JOIN source_document USING (content_hash)
 WHERE NOT flying AND inbox_path IS NOT NULL AND (TIMESTAMP '{AS_OF}' - coalesce(good, bad)) >= CASE WHEN good IS NULL THEN INTERVAL '14' DAY ELSE INTERVAL '48' HOUR END""")
def x10_reap_uploads(d):
    return retention.reapable_uploads(d.documents, d.jobs, ntz(AS_OF)).select("content_hash", "ended_at")


@query(f" SELECT id FROM conversion_job WHERE ended_at < TIMESTAMP '{SINCE}' AND status NOT IN ('queued', 'submitted', 'running')")
def x11_prunable_jobs(d):
    return retention.prunable_jobs(d.jobs, ntz(SINCE)).select("id")
