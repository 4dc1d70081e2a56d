"""Parts: planning page ranges, retrying and halving, joining with gaps marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill import states

# What a gap in a joined document says, around its page range, and the reasons of parts and jobs that fail.
GAP = ("> **Pages ", " are missing from this document.** That part could not be converted, so its content is absent here. Convert those pages separately if you need them.")
PART_LOST = "The converter lost these pages before their result could be saved, and they could not be converted again."
PART_TIMEOUT = "These pages were still converting after the time limit, even on their own. Whatever is on them costs far more than the rest of the document."
LOST_RESULT = "The document was converted but the result could not be saved, so it was lost. Please convert it again."
LOST_FILE = "This document was interrupted by a restart and the uploaded file is no longer available. Please upload it again."
CRASHED = (
    "This document was interrupted and resumed ",
    " times without finishing, so the service has stopped trying to convert it. It may be too large for the memory this service is given. Convert it in smaller pieces, or give the service more memory.",
)
TIMED_OUT = ("This document was still converting after ", " minutes and was stopped. It may be very large or unusually complex.")


def plan_parts(documents: DataFrame, max_pages: int = states.PART_MAX_PAGES, *, pages: str = "page_count") -> DataFrame:
    """A row per part of each document: ordinal from 1, first_page, last_page. Fewer than one page is an error."""
    if max_pages < 1:
        raise ValueError("max_pages must be at least 1")
    count = F.when(F.col(pages) >= 1, F.col(pages).cast("int")).otherwise(F.raise_error(F.lit("pages must be at least 1")).cast("int"))
    starts = documents.select("*", F.posexplode(F.sequence(F.lit(1), count, F.lit(max_pages))).alias("__at", "first_page"))
    return starts.withColumn("ordinal", F.col("__at") + 1).withColumn("last_page", F.least(F.col("first_page") + max_pages - 1, F.col(pages).cast("int"))).drop("__at")


def halves() -> Column:
    """Both halves of a part's range."""
    pages = F.col("last_page") - F.col("first_page") + 1
    middle = (F.col("first_page") + F.floor(pages / 2) - 1).cast("int")
    return F.array(F.struct(F.col("first_page").alias("first"), middle.alias("last")), F.struct((middle + 1).alias("first"), F.col("last_page").alias("last")))


def halve_parts(parts: DataFrame, doomed: Column, top: str = "ordinal") -> DataFrame:
    """Parts, those that doomed holds for replaced by their halves.

    New ordinals follow the job's largest one, in reading order; halves are queued, one level deeper.
    top names a column that knows the largest ordinal where parts are not all of their job's.
    """
    job = Window.partitionBy("job_id")
    marked = parts.withColumn("__doomed", F.coalesce(doomed, F.lit(False))).withColumn("__top", F.max(F.greatest("ordinal", F.col(top))).over(job) if top != "ordinal" else F.max("ordinal").over(job))
    kept = marked.where(~F.col("__doomed")).drop("__doomed", "__top")
    halved = marked.where("__doomed").withColumn("__half", F.explode(halves()))
    fresh = halved.withColumn("__nth", F.row_number().over(job.orderBy("__half.first"))).withColumns(
        {
            "ordinal": (F.col("__top") + F.col("__nth")).cast("int"),
            "id": F.concat(F.col("job_id"), F.lit("-"), (F.col("__top") + F.col("__nth")).cast("string")),
            "first_page": F.col("__half.first"),
            "last_page": F.col("__half.last"),
            "status": F.lit("queued"),
            "attempt": F.lit(1),
            "split_depth": F.col("split_depth") + 1,
            **{c: F.lit(None).cast(dict(parts.dtypes)[c]) for c in ("markdown", "failure_reason", "engine_task_id", "started_at", "ended_at", "part_path") if c in parts.columns},
        }
    )
    return kept.unionByName(fresh.select(*kept.columns))


def can_shrink(max_depth: int = states.PART_RETRY_SPLITS, min_pages: int = states.PART_MIN_PAGES) -> Column:
    pages = F.col("last_page") - F.col("first_page") + 1
    return (F.col("split_depth") < max_depth) & (pages > min_pages) & (pages >= 2)


def retry_action(event: Column, max_attempts: int = states.PART_MAX_ATTEMPTS, max_depth: int = states.PART_RETRY_SPLITS, min_pages: int = states.PART_MIN_PAGES) -> Column:
    """What becomes of a part that was lost, failed or timed_out: requeue, halve or give_up."""
    smaller = F.when(can_shrink(max_depth, min_pages), F.lit("halve")).otherwise(F.lit("give_up"))
    return F.when((event == "lost") & (F.col("attempt") < max_attempts), F.lit("requeue")).when(event.isNotNull(), smaller)


def apply_retries(parts: DataFrame, action: str = "action", event: str = "event", reason: str = "reason", top: str = "ordinal") -> DataFrame:
    """Parts after their actions: requeued, halved, or finished with a reason; other parts unchanged."""
    own = [c for c in parts.columns if c not in (action, event, reason)]
    requeue, over = F.coalesce(F.col(action) == "requeue", F.lit(False)), F.coalesce(F.col(action) == "give_up", F.lit(False))
    ended = F.when(F.col(event) == "timed_out", F.lit("timed_out")).otherwise(F.lit("failed"))
    done = parts.withColumns(
        {
            "status": F.when(requeue, F.lit("queued")).when(over, ended).otherwise(F.col("status")),
            "attempt": F.when(requeue, F.col("attempt") + 1).otherwise(F.col("attempt")),
            "failure_reason": F.when(over, F.col(reason)).otherwise(F.col("failure_reason")),
        }
    )
    return halve_parts(done, F.col(action) == "halve", top).select(*own)


def reading_order(parts: DataFrame) -> DataFrame:
    """Parts with position, their place in the document; the ordinal alone is none."""
    return parts.withColumn("position", F.row_number().over(Window.partitionBy("job_id").orderBy("first_page", "ordinal")))


def gap_notice(first: Column, last: Column) -> Column:
    return F.concat(F.lit(GAP[0]), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(GAP[1]))


def join_parts(parts: DataFrame) -> DataFrame:
    """Per job its markdown, missing_page_ranges, part counts, and failure_reason where all parts failed.

    A document's parts meet in one row, as its text must; nothing else is grouped. Where parts have an
    engine_status, any_partial tells whether one of them was converted in part.
    """
    partial = [F.coalesce(F.bool_or(F.col("engine_status") == "partial_success"), F.lit(False)).alias("any_partial")] if "engine_status" in parts.columns else []
    fine = F.col("status") == "succeeded"
    piece = F.when(fine & F.col("markdown").isNotNull(), F.col("markdown")).otherwise(gap_notice(F.col("first_page"), F.col("last_page")))
    entry = F.struct("first_page", "ordinal", "last_page", fine.alias("fine"), piece.alias("text"), "failure_reason")
    grouped = parts.groupBy("job_id").agg(F.array_sort(F.collect_list(entry)).alias("all"), F.count_if(fine).alias("succeeded"), F.count("*").alias("part_count"), *partial)
    pieces = F.transform(F.filter("all", lambda p: p["text"] != ""), lambda p: F.regexp_replace(p["text"], r"^\n+|\n+$", ""))
    missing = F.transform(F.filter("all", lambda p: ~p["fine"]), lambda p: F.struct(p["first_page"].alias("first_page"), p["last_page"].alias("last_page")))
    none = F.col("succeeded") == 0
    return grouped.select(
        "job_id",
        F.when(~none, F.concat(F.array_join(pieces, "\n\n"), F.lit("\n"))).alias("markdown"),
        F.when(F.size(missing) > 0, missing).alias("missing_page_ranges"),
        "part_count",
        "succeeded",
        F.when(none, F.coalesce(F.col("all")[0]["failure_reason"], F.lit(LOST_RESULT))).alias("failure_reason"),
        *["any_partial" for _ in partial],
    )


def missing_ranges(parts: DataFrame) -> DataFrame:
    """T4: per job the ranges that did not convert, in order; null if none, and the text columns unread."""
    entry = F.when(F.col("status") != "succeeded", F.struct("first_page", "last_page"))
    grouped = parts.groupBy("job_id").agg(F.array_sort(F.collect_list(entry)).alias("m"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.min_by("failure_reason", F.struct("first_page", "ordinal")).alias("first_reason"))
    return grouped.select(
        "job_id", F.when(F.size("m") > 0, F.col("m")).alias("missing_page_ranges"), F.when(F.col("succeeded") == 0, F.coalesce("first_reason", F.lit(LOST_RESULT))).alias("failure_reason")
    )


def coverage_faults(parts: DataFrame, pages: DataFrame) -> DataFrame:
    """Gaps and overlaps of each job's ranges against 1..pages (pages: job_id, pages)."""
    along = Window.partitionBy("job_id").orderBy("first_page", "last_page")
    before = F.coalesce(F.max("last_page").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = parts.select("job_id", "first_page", "last_page").withColumn("before", before)
    fault = F.when(F.col("first_page") > F.col("before") + 1, "gap").when(F.col("first_page") <= F.col("before"), "overlap")
    low = F.when(F.col("first_page") > F.col("before") + 1, F.col("before") + 1).otherwise(F.col("first_page"))
    high = F.when(F.col("first_page") > F.col("before") + 1, F.col("first_page") - 1).otherwise(F.least("before", "last_page"))
    inner = steps.withColumn("fault", fault).where("fault IS NOT NULL").select("job_id", "fault", low.alias("from_page"), high.alias("to_page"))
    ends = pages.join(parts.groupBy("job_id").agg(F.max("last_page").alias("end")), "job_id", "left").withColumn("end", F.coalesce("end", F.lit(0)))
    tail = ends.where("end <> pages").select(
        "job_id", F.when(F.col("end") < F.col("pages"), "gap").otherwise("overrun").alias("fault"), (F.least("end", "pages") + 1).alias("from_page"), F.greatest("end", "pages").alias("to_page")
    )
    return inner.unionByName(tail)


def part_counters(jobs: DataFrame, parts: DataFrame) -> DataFrame:
    """A4: each job's part_count and parts_completed from its parts; jobs without parts keep theirs."""
    counted = parts.groupBy(F.col("job_id").alias("id")).agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("status").isin(*states.TERMINAL_PART)).cast("int").alias("d"))
    return jobs.join(counted, "id", "left").withColumns({"part_count": F.coalesce("n", "part_count"), "parts_completed": F.coalesce("d", "parts_completed")}).drop("n", "d")


def gap_reasons(parts: DataFrame, job_id: str | None = None) -> DataFrame:
    """Why parts are missing, the most frequent reason first."""
    chosen = parts if job_id is None else parts.where(F.col("job_id") == job_id)
    return chosen.where("failure_reason IS NOT NULL").groupBy("failure_reason").agg(F.count("*").alias("parts")).orderBy(F.desc("parts"), "failure_reason")


def overdue_jobs(jobs: DataFrame, as_of: Column, limit: int = states.JOB_TIMEOUT_SECONDS) -> DataFrame:
    """Unsplit jobs with the engine whose age, from creation, has reached the limit; with their reason."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    late = jobs.where(F.col("status").isin(*states.CONVERTING) & (F.col("part_count") <= 1)).withColumn("age_seconds", age)
    return late.where(F.col("age_seconds") >= limit).withColumn("failure_reason", F.lit(f"{TIMED_OUT[0]}{round(limit / 60)}{TIMED_OUT[1]}"))


def overdue_parts(parts: DataFrame, as_of: Column, limit: int = states.JOB_TIMEOUT_SECONDS, max_depth: int = states.PART_RETRY_SPLITS, min_pages: int = states.PART_MIN_PAGES) -> DataFrame:
    """Parts with the engine past the limit on their own clock, and whether they are halved or given up."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.coalesce("started_at", "created_at").cast("timestamp"))
    late = parts.where(F.col("status").isin(*states.CONVERTING)).withColumn("age_seconds", age).where(F.col("age_seconds") >= limit)
    return late.withColumn("action", F.when(can_shrink(max_depth, min_pages), "halve").otherwise("give_up"))


def forgotten_jobs(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Jobs with the engine whose task it no longer knows (tasks: engine_task_id)."""
    return jobs.where(F.col("status").isin(*states.CONVERTING)).join(tasks.select("engine_task_id"), "engine_task_id", "left_anti")


def recovery_plan(jobs: DataFrame, inbox: DataFrame, max_attempts: int | None = states.JOB_MAX_ATTEMPTS) -> DataFrame:
    """What a restart does with each unfinished job: fail or requeue, the new attempt, and the reason.

    Without max_attempts there is no ceiling, as for jobs whose task was forgotten.
    """
    held = inbox.select("content_hash").distinct().withColumn("__held", F.lit(True))
    flying = jobs.where(F.col("status").isin(*states.IN_FLIGHT)).join(held, "content_hash", "left")
    spent = F.lit(False) if max_attempts is None else F.col("attempt") + 1 > max_attempts
    crash = F.concat(F.lit(CRASHED[0]), F.col("attempt").cast("string"), F.lit(CRASHED[1]))
    return flying.select(
        "id",
        F.when(spent | F.col("__held").isNull(), "fail").otherwise("requeue").alias("action"),
        F.when(~spent & F.col("__held").isNotNull(), F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"),
        F.when(spent, crash).when(F.col("__held").isNull(), F.lit(LOST_FILE)).alias("failure_reason"),
    )


def requeue_unfinished_parts(parts: DataFrame, plan: DataFrame) -> DataFrame:
    """Parts of requeued jobs, the unfinished ones queued again; finished parts keep their text."""
    back = plan.where("action = 'requeue'").select(F.col("id").alias("job_id")).withColumn("__back", F.lit(True))
    again = F.col("__back").isNotNull() & ~F.col("status").isin(*states.TERMINAL_PART)
    blank = {c: F.when(~again, F.col(c)) for c in ("engine_task_id", "started_at") if c in parts.columns}
    return parts.join(back, "job_id", "left").withColumns({**blank, "status": F.when(again, F.lit("queued")).otherwise(F.col("status"))}).drop("__back")


def inconsistent_jobs(jobs: DataFrame, parts: DataFrame) -> DataFrame:
    """Queued split jobs that nobody watches: some part is with the engine (submit), or all are over (finish)."""
    state = parts.groupBy(F.col("job_id").alias("id")).agg(F.count_if(F.col("status").isin(*states.CONVERTING)).alias("flying"), F.bool_and(F.col("status").isin(*states.TERMINAL_PART)).alias("over"))
    queued = jobs.where((F.col("status") == "queued") & (F.col("part_count") >= 2)).join(state, "id")
    verdict = F.when(F.col("flying") > 0, "submit").when(F.col("over"), "finish")
    return queued.withColumn("repair", verdict).where("repair IS NOT NULL").select("id", "repair", F.col("flying").alias("parts_in_flight"))


def fail_remainder(parts: DataFrame, jobs: DataFrame, inbox: DataFrame) -> DataFrame:
    """Parts, the queued ones of jobs whose upload is gone failed with a reason."""
    gone = jobs.join(inbox.select("content_hash"), "content_hash", "left_anti").select(F.col("id").alias("job_id")).withColumn("__gone", F.lit(True))
    lost = F.col("__gone").isNotNull() & (F.col("status") == "queued")
    return parts.join(gone, "job_id", "left").withColumns({"failure_reason": F.when(lost, F.lit(LOST_FILE)).otherwise(F.col("failure_reason")), "status": F.when(lost, F.lit("failed")).otherwise(F.col("status"))}).drop("__gone")
