"""Retention, deletion and integrity of the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import states
from foliomill.sources.sinks import delete_keys, next_batch

#: Keys of the registry's tables where they are stored as tables of changes, each row with the time of its change.
VERSION = "changed_at"
STORED = {"source_document": ["content_hash"], "conversion_job": ["id"], "conversion_part": ["job_id", "ordinal"], "markdown_output": ["output_filename"]}


def reapable_uploads(documents: DataFrame, jobs: DataFrame, as_of: Column, hours: float = states.INBOX_RETENTION_HOURS, failed_days: float = states.FAILED_RETENTION_DAYS) -> DataFrame:
    """Retained uploads whose time is over: content_hash, ended_at, age_hours, limit_hours.

    A document with a job in flight, or without any job, stays. One aggregation by document.
    """
    good, bad = F.col("status").isin(*states.DOWNLOADABLE), F.col("status").isin("failed", "timed_out")
    state = jobs.groupBy("content_hash").agg(
        F.bool_or(F.col("status").isin(*states.IN_FLIGHT)).alias("flying"), F.max(F.when(good, F.col("ended_at"))).alias("good_end"), F.max(F.when(bad, F.col("ended_at"))).alias("bad_end")
    )
    held = documents.where("inbox_path IS NOT NULL").select("content_hash").join(state.where("NOT flying"), "content_hash")
    end = F.coalesce("good_end", "bad_end")
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(end.cast("timestamp"))) / 3.6e9
    limit = F.when(F.col("good_end").isNotNull(), F.lit(float(hours))).otherwise(F.lit(float(failed_days * 24)))
    aged = held.select("content_hash", end.alias("ended_at"), age.alias("age_hours"), limit.alias("limit_hours"))
    return aged.where("age_hours >= limit_hours")


def clear_reaped(documents: DataFrame, reaped: DataFrame) -> DataFrame:
    """Documents with inbox_path cleared where the upload was reaped."""
    gone = reaped.select("content_hash").distinct().withColumn("__gone", F.lit(True))
    return documents.join(gone, "content_hash", "left").withColumn("inbox_path", F.when(F.col("__gone").isNull(), F.col("inbox_path"))).drop("__gone")


def prunable_jobs(jobs: DataFrame, before: Column) -> DataFrame:
    """X11: finished jobs that ended before the cutoff."""
    return jobs.where((F.col("ended_at") < before) & ~F.col("status").isin(*states.IN_FLIGHT))


def prune_history(jobs: DataFrame, parts: DataFrame, before: Column) -> tuple[DataFrame, DataFrame]:
    """X11: jobs and parts without those pruned; outputs stay."""
    gone = prunable_jobs(jobs, before).select("id")
    return jobs.join(gone, "id", "left_anti"), parts.join(gone.withColumnRenamed("id", "job_id"), "job_id", "left_anti")


def deletion_plan(documents: DataFrame, jobs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Per asked document (all by default) whether it is deleted or skipped because a job converts it."""
    wanted = documents if asked is None else documents.join(asked.select("content_hash"), "content_hash", "left_semi")
    busy = jobs.where(F.col("status").isin(*states.CONVERTING)).select("content_hash").distinct().withColumn("__busy", F.lit(True))
    return wanted.join(busy, "content_hash", "left").select("content_hash", "original_filename", F.when(F.col("__busy"), "skipped").otherwise("deleted").alias("action"))


def delete_documents(plan: DataFrame, batches: DataFrame, documents: DataFrame, jobs: DataFrame, parts: DataFrame, outputs: DataFrame) -> dict[str, DataFrame]:
    """The registry without the documents that the plan deletes; batches stay."""
    doomed = plan.where("action = 'deleted'").select("content_hash")
    gone = jobs.join(doomed, "content_hash", "left_semi").select(F.col("id").alias("job_id"))
    return {
        "batch": batches,
        "source_document": documents.join(doomed, "content_hash", "left_anti"),
        "conversion_job": jobs.join(doomed, "content_hash", "left_anti"),
        "conversion_part": parts.join(gone, "job_id", "left_anti"),
        "markdown_output": outputs.join(doomed, "content_hash", "left_anti"),
    }


def store_deletions(plan: DataFrame, jobs: DataFrame, parts: DataFrame, outputs: DataFrame, root: str, as_of: Column) -> None:
    """J6 on stored tables: tombstones for the documents that the plan deletes, their jobs, parts and outputs.

    Each table is a folder of that name under root, keyed as STORED tells and versioned by changed_at. Documents are
    marked last, so a run that fails is simply run again.
    """
    doomed = plan.where("action = 'deleted'").select("content_hash")
    gone = jobs.join(doomed, "content_hash", "left_semi").select("id")
    found = {
        "markdown_output": outputs.join(doomed, "content_hash", "left_semi").select("output_filename"),
        "conversion_part": parts.join(gone.withColumnRenamed("id", "job_id"), "job_id", "left_semi").select("job_id", "ordinal"),
        "conversion_job": gone,
        "source_document": doomed,
    }
    _bury(found, root, as_of)


def store_pruning(jobs: DataFrame, parts: DataFrame, root: str, before: Column, as_of: Column) -> None:
    """X11 on stored tables: tombstones for the jobs that ended before a time, and their parts; outputs stay."""
    gone = prunable_jobs(jobs, before).select("id")
    _bury({"conversion_part": parts.join(gone.withColumnRenamed("id", "job_id"), "job_id", "left_semi").select("job_id", "ordinal"), "conversion_job": gone}, root, as_of)


def _bury(found: dict[str, DataFrame], root: str, as_of: Column) -> None:
    for table, keys in found.items():
        path = f"{root.rstrip('/')}/{table}"
        delete_keys(keys.withColumn(VERSION, as_of), path, next_batch(keys.sparkSession, path))


def deletion_summary(plan: DataFrame, jobs: DataFrame, outputs: DataFrame, present: DataFrame) -> DataFrame:
    """Documents and jobs deleted, files removed and already gone, documents skipped."""
    doomed = plan.where("action = 'deleted'").select("content_hash")
    counts = plan.agg(F.count_if(F.col("action") == "deleted").alias("documents"), F.count_if(F.col("action") == "skipped").alias("skipped"))
    of_jobs = jobs.join(doomed, "content_hash", "left_semi").agg(F.count("*").alias("jobs"))
    there = present.select("output_filename").distinct().withColumn("__here", F.lit(True))
    files = outputs.join(doomed, "content_hash", "left_semi").join(there, "output_filename", "left")
    of_files = files.agg(F.count_if(F.col("__here").isNotNull()).alias("removed"), F.count_if(F.col("__here").isNull()).alias("kept"))
    rows = counts.unionByName(of_jobs, allowMissingColumns=True).unionByName(of_files, allowMissingColumns=True)
    return rows.agg(*[F.sum(c).alias(c) for c in ("documents", "jobs", "removed", "kept", "skipped")])


def integrity_violations(batches: DataFrame, documents: DataFrame, jobs: DataFrame, parts: DataFrame, outputs: DataFrame) -> DataFrame:
    """(rule, key) of every violation, and of uploads that retention never reaps as their jobs are gone.

    An output's job may be unknown by design.
    """
    said = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    orphan = lambda df, column, to, key, rule, name: said(df.where(F.col(column).isNotNull()).join(to.select(F.col(key).alias(column)), column, "left_anti"), rule, name)
    twice = lambda df, keys, rule: said(df.groupBy(F.concat_ws("/", *keys).alias("k")).count().where("count > 1"), rule, "k")
    found = [
        orphan(jobs, "content_hash", documents, "content_hash", "job without document", "id"),
        orphan(jobs, "batch_id", batches, "id", "job without batch", "id"),
        orphan(parts, "job_id", jobs, "id", "part without job", "id"),
        orphan(outputs, "content_hash", documents, "content_hash", "output without document", "output_filename"),
        said(jobs.where(~F.col("status").isin(*states.JOB_STATES) | F.col("status").isNull()), "unknown job status", "id"),
        said(parts.where(~F.col("status").isin(*states.PART_STATES) | F.col("status").isNull()), "unknown part status", "id"),
        said(outputs.where(~F.col("engine_status").isin(*states.ENGINE_STATES)), "unknown engine status", "output_filename"),
        twice(jobs, ["id"], "repeated job"),
        twice(documents, ["content_hash"], "repeated document"),
        twice(outputs, ["output_filename"], "repeated output"),
        twice(parts, ["job_id", "ordinal"], "repeated part"),
        said(documents.where("inbox_path IS NOT NULL").join(jobs.select("content_hash"), "content_hash", "left_anti"), "upload without jobs", "content_hash"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
