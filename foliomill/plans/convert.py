"""Converting a corpus with a user's function, with retries, halving and gaps marked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from foliomill import states
from foliomill.functions.status import failure_reason, is_suspect, outcome
from foliomill.operators.parts import PART_TIMEOUT, apply_retries, join_parts, plan_parts, retry_action
from foliomill.operators.registry import already_converted
from foliomill.operators.sections import plan_outputs, superseded_outputs
from foliomill.plans.isolated import call, convert_isolated
from foliomill.shared import fresh_path
from foliomill.sources.sinks import replace_outputs

#: A converter takes a frame of parts and returns, in the same order, (markdown, status, errors) of each.
Converter = Callable[[pd.DataFrame], "list[tuple[str | None, str, list[str]]]"]
CONVERTED = StructType([StructField("new_markdown", StringType()), StructField("engine_status", StringType()), StructField("errors", ArrayType(StringType()))])


def convert_parts(parts: DataFrame, converter: Converter, deadline: float | None = states.JOB_TIMEOUT_SECONDS, memory: int | None = None) -> DataFrame:
    """Parts with new_markdown, engine_status and errors, by the converter in Spark's tasks; what it raises becomes failed rows.

    With a deadline (seconds for a part) it is called in a child process, a part at a time: parts past it
    are timed_out, those whose process ended are lost, and memory bounds what it may take. Without one it
    is called in the worker with whole batches, and a batch that raises is tried again row by row.
    """

    def whole(batch: pd.DataFrame) -> list[tuple]:
        try:
            found = list(converter(batch))
            if len(found) == len(batch):
                return found
        except Exception:  # noqa: BLE001  found out part by part
            pass
        return [call(converter, batch.iloc[n : n + 1]) for n in range(len(batch))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            results = whole(rows) if deadline is None else convert_isolated(converter, rows, deadline, memory)
            told = [pa.array([r[0] for r in results], pa.string()), pa.array([r[1] for r in results], pa.string()), pa.array([list(r[2]) for r in results], pa.list_(pa.string()))]
            # the part's own columns pass as they came
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*batch.schema.names, *CONVERTED.names])

    return parts.mapInArrow(run, StructType([*parts.schema.fields, *CONVERTED.fields]))


def convert_corpus(
    jobs: DataFrame,
    converter: Converter,
    *,
    max_pages: int = states.PART_MAX_PAGES,
    max_attempts: int = states.PART_MAX_ATTEMPTS,
    max_depth: int = states.PART_RETRY_SPLITS,
    min_pages: int = states.PART_MIN_PAGES,
    work: str | None = None,
    deadline: float | None = states.JOB_TIMEOUT_SECONDS,
    memory: int | None = None,
) -> DataFrame:
    """Per job (id, content_hash, page_count, further columns reach the converter) its joined document.

    Returns job_id, status, markdown, missing_page_ranges, part_count, failure_reason, any_partial. Each
    round converts the queued parts only, writes their results to the shared folder and reads them back,
    so nothing is converted or written twice; a part is requeued, halved or given up by X4, and finished
    parts stay in the round that made them until all are joined. Rounds are bounded by the attempts of a
    part times its possible depths; parts that are still queued after them are an error.
    """
    spark = jobs.sparkSession
    folder = fresh_path(spark, "convert", work)
    extra = [c for c in jobs.columns if c not in ("id", "page_count")]
    planned = plan_parts(jobs.where(F.coalesce("page_count", F.lit(0)) >= 1), max_pages)
    whole = jobs.where(F.coalesce("page_count", F.lit(0)) < 1).select("*", F.lit(1).alias("first_page"), F.lit(1).alias("ordinal"), F.lit(1).alias("last_page"))
    top = F.greatest(F.lit(1), F.ceil(F.coalesce("page_count", F.lit(0)) / F.lit(max_pages))).cast("int")
    queued = planned.unionByName(whole).select(
        F.concat(F.col("id"), F.lit("-"), F.col("ordinal").cast("string")).alias("id"),
        F.col("id").alias("job_id"), F.col("ordinal").cast("int").alias("ordinal"), F.col("first_page").cast("int").alias("first_page"), F.col("last_page").cast("int").alias("last_page"), *extra,
        F.lit("queued").alias("status"), F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("string").alias("failure_reason"), F.lit(1).alias("attempt"), F.lit(0).alias("split_depth"), top.alias("top"),
    )
    finished: list[DataFrame] = []
    slim = ["job_id", "ordinal", "first_page", "last_page", "status", "markdown", "failure_reason", "engine_status"]
    for turn in range(max_attempts * (max_depth + 1) + 1):
        fresh = convert_parts(queued, converter, deadline, memory)
        good = F.col("engine_status").isin("success", "partial_success")
        event = F.when(good, F.lit(None).cast("string")).when(F.col("engine_status").isin("lost", "timed_out"), F.col("engine_status")).otherwise(F.lit("failed"))
        reason = F.when(F.col("engine_status") == "timed_out", F.lit(PART_TIMEOUT)).otherwise(failure_reason(F.col("errors"), F.lit("failure")))
        # the event is written before the parts that follow from it, so that a converter runs once
        fresh = fresh.withColumns({"status": F.when(good, F.lit("succeeded")).otherwise(F.col("status")), "markdown": F.when(good, F.coalesce("new_markdown", F.lit(""))), "event": event, "reason": reason})
        fresh.drop("new_markdown", "errors").write.parquet(f"{folder}/converted-{turn}")
        seen = spark.read.parquet(f"{folder}/converted-{turn}")
        finished.append(seen.where("event IS NULL").select(slim))
        left = seen.where("event IS NOT NULL")
        if left.isEmpty():
            break
        acted = apply_retries(left.withColumn("action", retry_action(F.col("event"), max_attempts, max_depth, min_pages)), top="top")
        grown = F.max(F.greatest("top", "ordinal")).over(Window.partitionBy("job_id"))
        acted.withColumn("top", grown).write.parquet(f"{folder}/parts-{turn}")
        acted = spark.read.parquet(f"{folder}/parts-{turn}")
        finished.append(acted.where("status <> 'queued'").select(slim))
        queued = acted.where("status = 'queued'").drop("engine_status")
        if queued.isEmpty():
            break
    else:
        raise RuntimeError(f"parts are still queued after {turn + 1} rounds; their results are under {folder}")
    parts = finished[0]
    for more in finished[1:]:
        parts = parts.unionByName(more)
    joined = join_parts(parts)
    known = jobs.select(F.col("id").alias("job_id"), "page_count")
    suspect = is_suspect(F.col("markdown"), F.col("page_count"))
    status = F.when(F.col("markdown").isNull(), F.lit("failed")).otherwise(outcome(suspect, F.col("missing_page_ranges")))
    return joined.join(known, "job_id").select("job_id", status.alias("status"), "markdown", "missing_page_ranges", F.col("part_count").cast("int").alias("part_count"), "failure_reason", "any_partial")


def convert_batch(queued: DataFrame, outputs: DataFrame, present: DataFrame, jobs: DataFrame, converter: Converter, path: str, *, require_all: bool = False, work: str | None = None, **options) -> dict[str, DataFrame]:
    """C1 whole: claims what is already converted, converts the rest, and stores its files under path instead of earlier ones.

    queued: id, content_hash, submitted_filename, page_count. A document that several jobs ask for is
    converted once, for the job with the greatest id; the others claim its output. Returns claimed,
    converted (a row per converted document), files (what was stored), superseded (earlier outputs that
    are no longer there) and stored (files and bytes per document).
    """
    spark = queued.sparkSession
    folder = fresh_path(spark, "batch", work)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    claimed = kept(already_converted(queued, outputs, present, jobs, require_all), "claimed")
    todo = queued.join(claimed.select("id"), "id", "left_anti")
    one = F.max_by(F.struct("id", "submitted_filename", "page_count"), F.col("id")).alias("t")
    todo = kept(todo.groupBy("content_hash").agg(one).select("t.id", "content_hash", "t.submitted_filename", "t.page_count"), "todo")
    converted = kept(convert_corpus(todo.select("id", "content_hash", "page_count"), converter, work=work, **options), "converted")
    texts = converted.where("markdown IS NOT NULL").select(F.col("job_id").alias("id"), "markdown").join(todo, "id")
    files = kept(plan_outputs(texts.select("content_hash", F.col("submitted_filename").alias("filename"), "markdown")), "files")
    superseded = kept(superseded_outputs(outputs, files), "superseded")
    return {"claimed": claimed, "converted": converted, "files": files, "superseded": superseded, "stored": replace_outputs(files, path)}
