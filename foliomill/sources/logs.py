"""Structured job logs and engine results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill import schemas, states
from foliomill.functions.status import page_count_of

PAIR = r'(\w+)=("[^"]*"|\S+)'
LINE = rf"(?:^|\s)({'|'.join(states.EVENTS)}) (job_id=.*)$"


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Event, job_id, file, fields (map), raw and parse_ok of each line `event job_id=… file="…" key=value …`.

    A quoted value ends at the next quote, as writers do not escape; the raw line stays. Of a key that
    repeats, the last value stays.
    """
    # each step is a column of its own, so that no pattern runs again for each entry
    found = lines.select(F.col(column).alias("raw"), F.regexp_extract(column, LINE, 1).alias("__event"), F.regexp_extract(column, LINE, 2).alias("__body"))
    found = found.withColumns({"__keys": F.regexp_extract_all("__body", F.lit(PAIR), F.lit(1)), "__values": F.regexp_extract_all("__body", F.lit(PAIR), F.lit(2))})
    entries = F.zip_with("__keys", "__values", lambda k, v: F.struct(k.alias("key"), F.regexp_replace(v, '^"|"$', "").alias("value")))
    # of equal keys the last entry stays: no later key is the same
    later = lambda i: F.slice("__keys", i + 2, F.greatest(F.size("__keys") - i - 1, F.lit(0)))
    found = found.withColumn("__entries", entries).withColumn("__last", F.filter("__entries", lambda e, i: ~F.array_contains(later(i), e["key"])))
    pick = lambda name: F.try_element_at(F.filter("__last", lambda e: e["key"] == name), F.lit(1))["value"]
    event = F.nullif(F.col("__event"), F.lit(""))
    return found.select(
        event.alias("event"),
        pick("job_id").alias("job_id"),
        pick("file").alias("file"),
        F.map_from_entries(F.filter("__last", lambda e: ~e["key"].isin("job_id", "file"))).alias("fields"),
        "raw",
        (event.isNotNull() & (F.trim(F.regexp_replace("__body", PAIR, "")) == "")).alias("parse_ok"),
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def stream_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.readStream.text(path))


def parse_results(rows: DataFrame, body: str = "body") -> DataFrame:
    """Rows with markdown ('' if absent), status ('failure' if absent), errors, processing_time, page_count, corrupt."""
    parsed = F.from_json(F.col(body), schemas.ENGINE_RESULT)
    good = _is_object(F.col(body))
    return rows.withColumn("__r", parsed).select(
        *rows.columns,
        F.coalesce("__r.document.md_content", F.lit("")).alias("markdown"),
        F.coalesce("__r.status", F.lit("failure")).alias("status"),
        F.coalesce("__r.errors", F.array().cast("array<string>")).alias("errors"),
        F.col("__r.processing_time").alias("processing_time"),
        page_count_of(F.col(body)).alias("page_count"),
        (~good).alias("corrupt"),
    )


def _is_object(body: Column) -> Column:
    return F.coalesce(F.try_parse_json(body).isNotNull() & (F.substring(F.trim(body), 1, 1) == "{"), F.lit(False))
