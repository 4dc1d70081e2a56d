"""Reads over the registry: filters, views, counts, admission.

Every operator takes DataFrames and returns a lazy DataFrame; filters are plain conjunctions, so they
reach the Parquet scan, and joins are equi-joins whose strategy is Catalyst's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill import states


def list_jobs(jobs: DataFrame, *, batch_id: str | None = None, status: Sequence[str] | None = None, since=None, content_hash: str | None = None, job_id: str | None = None) -> DataFrame:
    """Jobs that meet all given conditions; since is strict. An unknown status is an error."""
    if unknown := set(status or ()) - set(states.JOB_STATES):
        raise ValueError(f"unknown status {sorted(unknown)}")
    for column, value in (("batch_id", batch_id), ("content_hash", content_hash), ("id", job_id)):
        if value is not None:
            jobs = jobs.where(F.col(column) == value)
    if status is not None:
        jobs = jobs.where(F.col("status").isin(*status))
    if since is not None:
        jobs = jobs.where(F.col("updated_at") > F.lit(since))
    return jobs


def change_marker(jobs: DataFrame) -> DataFrame:
    """The marker of the next incremental read, the latest change seen."""
    return jobs.agg(F.max("updated_at").alias("marker"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs the engine works on."""
    return jobs.where(F.col("status").isin(*states.CONVERTING))


def in_flight_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that are not finished."""
    return jobs.where(F.col("status").isin(*states.IN_FLIGHT))


def jobs_of_document(jobs: DataFrame, content_hash: str) -> DataFrame:
    """A document's jobs, newest first."""
    return jobs.where(F.col("content_hash") == content_hash).orderBy(F.desc("created_at"), "id")


def retained_documents(documents: DataFrame) -> DataFrame:
    """Documents whose upload is still held."""
    return documents.where(F.col("inbox_path").isNotNull())


def part_states(parts: DataFrame) -> DataFrame:
    """Parts without their text; the column is not read."""
    return parts.drop("markdown")


def job_view(jobs: DataFrame, documents: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each job with its document, and its output where it has one."""
    doc = documents.select("content_hash", "original_filename", "size_bytes", "page_count", "inbox_path")
    out = outputs.select("output_filename", "engine_status", F.col("bytes").alias("output_bytes"))
    return jobs.join(doc, "content_hash").join(out, "output_filename", "left")


def latest_output(outputs: DataFrame) -> DataFrame:
    """The latest output of each document; of one run, the first section, then the least name.

    An aggregate instead of a window, so a document with many outputs is reduced map-side.
    """
    order = F.struct(F.col("written_at"), (-F.coalesce(F.col("section_ordinal"), F.lit(-1))).alias("section"))
    top = outputs.groupBy("content_hash", "output_filename").agg(F.max(order).alias("o"), F.max_by("job_id", order).alias("job_id"))
    # names sort upwards within equal order: two steps, as a name has no negative
    best = top.groupBy("content_hash").agg(F.max("o").alias("best"))
    return top.join(best, "content_hash").where(F.col("o") == F.col("best")).groupBy("content_hash").agg(
        F.min("output_filename").alias("output_filename"), F.min_by("job_id", "output_filename").alias("job_id"), F.first("best.written_at").alias("written_at")
    )


def already_converted(queued: DataFrame, outputs: DataFrame, present: DataFrame, jobs: DataFrame, require_all: bool = False) -> DataFrame:
    """Queued jobs whose document's latest output is present and was not made with gaps.

    present lists output_filename. A producer that is no longer known counts as complete. With
    require_all, all outputs of the run that made the latest one must be present.
    """
    latest = latest_output(outputs)
    there = latest.join(present.select("output_filename"), "output_filename", "left_semi")
    if require_all:
        run = outputs.join(latest.select("content_hash", "job_id"), ["content_hash", "job_id"], "left_semi")
        there = there.join(run.join(present.select("output_filename"), "output_filename", "left_anti"), "content_hash", "left_anti")
    gaps = (F.col("status") == "succeeded_incomplete") | (F.coalesce(F.size("missing_page_ranges"), F.lit(0)) > 0)
    holed = jobs.where(gaps).select(F.col("id").alias("job_id"))
    whole = there.join(holed, "job_id", "left_anti").select("content_hash", F.col("output_filename").alias("claimed_output"))
    return queued.join(whole, "content_hash")


def document_outputs(outputs: DataFrame) -> DataFrame:
    """Every output with its position, from 1, in the section order of its document."""
    order = Window.partitionBy("content_hash").orderBy(F.coalesce("section_ordinal", F.lit(0)), "output_filename", "job_id")
    return outputs.withColumn("position", F.row_number().over(order))


def output_details(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Jobs with the positions of the outputs that each wrote, among those of its document (document_outputs).

    A document's list is told once, by document_outputs, and each job tells places in it: as many rows and
    positions as there are jobs and outputs, however many jobs a document has.
    """
    own = document_outputs(outputs).groupBy("content_hash", F.col("job_id").alias("id")).agg(F.array_sort(F.collect_list("position")).alias("positions"))
    joined = jobs.join(own, ["content_hash", "id"], "left")
    return joined.withColumn("positions", F.coalesce("positions", F.array().cast("array<int>")))


def missing_parts(jobs: DataFrame, parts: DataFrame) -> DataFrame:
    """Of split jobs with gaps, the parts that did not succeed."""
    gaps = jobs.where((F.col("part_count") >= 2) & (F.size("missing_page_ranges") > 0)).select(F.col("id").alias("job_id"))
    failed = part_states(parts).where(F.col("status") != "succeeded")
    return failed.join(gaps, "job_id").select("job_id", "first_page", "last_page", "status", F.col("attempt").alias("attempts"), "failure_reason")


def busy_documents(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that a job is converting; queued jobs do not count."""
    return documents.join(active_jobs(jobs).select("content_hash"), "content_hash", "left_semi")


def with_upload(jobs: DataFrame, inbox: DataFrame) -> DataFrame:
    """Each job with has_upload, whether its document's file is retained (inbox lists content_hash)."""
    held = inbox.select("content_hash").distinct().withColumn("has_upload", F.lit(True))
    return jobs.join(held, "content_hash", "left").withColumn("has_upload", F.coalesce("has_upload", F.lit(False)))


def retry_eligibility(jobs: DataFrame, inbox: DataFrame) -> DataFrame:
    """Whether each job may be tried again."""
    gone = ~F.col("has_upload")
    verdict = (
        F.when(F.col("status").isin(*states.IN_FLIGHT), "still_converting")
        .when(F.col("status").isin(*states.DOWNLOADABLE) & (F.col("status") != "succeeded_incomplete"), "already_converted")
        .when(gone, "upload_gone")
        .otherwise("eligible")
    )
    return with_upload(jobs, inbox).withColumn("retry", verdict)


def retried_jobs(eligible: DataFrame, moment: Column) -> DataFrame:
    """The new jobs of eligible ones: same document, name and batch, queued anew."""
    new_id = F.concat(F.lit("retry-"), F.col("id"))
    return eligible.where("retry = 'eligible'").select(
        new_id.alias("id"), "batch_id", "content_hash", "submitted_filename", F.lit("queued").alias("status"), moment.alias("created_at"), moment.alias("updated_at"), F.lit(1).alias("attempt")
    )


def output_availability(jobs: DataFrame, present: DataFrame) -> DataFrame:
    """What a request for a job's Markdown would meet."""
    here = present.select("output_filename").distinct().withColumn("here", F.lit(True))
    verdict = (
        F.when(~F.col("status").isin(*states.TERMINAL), "still_converting")
        .when(~F.col("status").isin(*states.DOWNLOADABLE) | F.col("output_filename").isNull(), "no_output")
        .when(F.col("here").isNull(), "output_removed")
        .otherwise("available")
    )
    return jobs.join(here, "output_filename", "left").withColumn("availability", verdict).drop("here")


def backlog(jobs: DataFrame) -> DataFrame:
    """A1: how many jobs wait and how many convert; zeros over no rows."""
    return jobs.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status").isin(*states.CONVERTING)).alias("converting"))


def batch_progress(jobs: DataFrame) -> DataFrame:
    """A2: per batch what failed, is done, waits and converts, and whether all is finished."""
    failed, queued = F.col("status").isin("failed", "timed_out"), F.col("status") == "queued"
    done = F.col("status").isin(*states.DOWNLOADABLE)
    return (
        jobs.groupBy("batch_id")
        .agg(
            F.count_if(failed).alias("failed"),
            F.count_if(done).alias("done"),
            F.count_if(queued).alias("waiting"),
            F.count_if(F.col("status").isin(*states.CONVERTING)).alias("converting"),
            F.count("*").alias("total"),
        )
        .withColumn("finished", F.col("failed") + F.col("done") == F.col("total"))
    )


def batch_states(jobs: DataFrame) -> DataFrame:
    """A2: jobs per batch and status."""
    return jobs.groupBy("batch_id", "status").agg(F.count("*").alias("jobs"))


def active_count(jobs: DataFrame) -> DataFrame:
    """A3: jobs the engine works on."""
    return jobs.agg(F.count_if(F.col("status").isin(*states.CONVERTING)).alias("active"))


def parts_in_flight(parts: DataFrame) -> DataFrame:
    """A3: per job its parts with the engine; 0 where there are none."""
    return parts.groupBy("job_id").agg(F.count_if(F.col("status").isin(*states.CONVERTING)).alias("in_flight"))


def output_count(outputs: DataFrame) -> DataFrame:
    """A3: outputs on record."""
    return outputs.agg(F.count("*").alias("outputs"))


def impact(jobs: DataFrame) -> DataFrame:
    """What clearing everything would take away."""
    return jobs.agg(F.count("*").alias("entries"), F.count_distinct("content_hash").alias("documents"), F.count_if(F.col("output_filename").isNotNull()).alias("with_output"))


def output_totals(outputs: DataFrame) -> DataFrame:
    """Files and bytes per job."""
    return outputs.groupBy("job_id").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def recent_jobs(jobs: DataFrame, limit: int = states.LIST_LIMIT) -> DataFrame:
    """L1: the newest jobs; a top-k, not a full sort."""
    if not 1 <= limit <= states.LIST_LIMIT_MAX:
        raise ValueError(f"limit must be between 1 and {states.LIST_LIMIT_MAX}")
    return jobs.orderBy(F.desc("created_at"), "id").limit(limit)


def output_inventory(outputs: DataFrame, limit: int = states.INVENTORY_LIMIT) -> DataFrame:
    """L2: the newest outputs."""
    return outputs.orderBy(F.desc("written_at"), "output_filename").limit(limit)


def document_inventory(documents: DataFrame) -> DataFrame:
    """L2: all documents, newest first."""
    return documents.select("content_hash", "first_seen_at").orderBy(F.desc("first_seen_at"), "content_hash")


def job_to_explain(jobs: DataFrame) -> DataFrame:
    """L3: the newest job with gaps, else the newest split job, else none."""
    gaps = F.coalesce(F.size("missing_page_ranges") > 0, F.lit(False))
    asked = jobs.where(gaps | (F.col("part_count") > 1))
    return asked.orderBy(F.when(gaps, 0).otherwise(1), F.desc("created_at"), "id").limit(1)


def admitted_jobs(jobs: DataFrame, max_in_flight: int = states.MAX_IN_FLIGHT) -> DataFrame:
    """Queued jobs that there is room for, oldest first.

    Only the first max_in_flight queued jobs can be admitted, so a top-k of that many goes through the
    rank, never the whole queue.
    """
    active = active_count(jobs)
    first = jobs.where("status = 'queued'").orderBy("created_at", "id").limit(max_in_flight)
    ranked = first.withColumn("place", F.row_number().over(Window.orderBy("created_at", "id")))
    return ranked.join(F.broadcast(active), F.col("place") <= max_in_flight - F.col("active")).drop("active")


def admitted_parts(parts: DataFrame, cap: int = states.PARTS_IN_FLIGHT) -> DataFrame:
    """Per job the queued parts that there is room for, in reading order."""
    job = Window.partitionBy("job_id")
    busy = F.count_if(F.col("status").isin(*states.CONVERTING)).over(job)
    place = F.row_number().over(job.orderBy(F.when(F.col("status") == "queued", 0).otherwise(1), "first_page", "ordinal"))
    return part_states(parts).withColumn("busy", busy).withColumn("place", place).where((F.col("status") == "queued") & (F.col("place") <= cap - F.col("busy"))).drop("busy")
