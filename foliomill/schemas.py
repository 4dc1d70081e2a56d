"""Schemas of the registry tables, and conforming older snapshots to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

BATCH = "id string, created_at timestamp, document_count int, submitter_note string"
SOURCE_DOCUMENT = "content_hash string, original_filename string, size_bytes long, page_count int, first_seen_at timestamp, inbox_path string"
CONVERSION_JOB = (
    "id string, batch_id string, content_hash string, submitted_filename string, status string, engine_task_id string, queue_position int, "
    "created_at timestamp, updated_at timestamp, started_at timestamp, ended_at timestamp, attempt int, failure_reason string, "
    "engine_errors array<string>, output_filename string, part_count int, parts_completed int, "
    "missing_page_ranges array<struct<first_page:int,last_page:int>>"
)
CONVERSION_PART = (
    "id string, job_id string, ordinal int, first_page int, last_page int, part_path string, status string, engine_task_id string, "
    "markdown string, failure_reason string, created_at timestamp, started_at timestamp, ended_at timestamp, attempt int, split_depth int"
)
MARKDOWN_OUTPUT = (
    "output_filename string, content_hash string, job_id string, bytes long, written_at timestamp, engine_status string, "
    "section_ordinal int, section_title string"
)
EXPECTATION = "file string, traits array<string>, pages string, headings int, tables int, figures int, must_contain array<string>, notes string"
ENGINE_RESULT = "document struct<md_content:string,page_count:int,num_pages:int,pages:int>, status string, errors array<string>, processing_time double, page_count int, num_pages int, pages int"

TABLES = {"batch": BATCH, "source_document": SOURCE_DOCUMENT, "conversion_job": CONVERSION_JOB, "conversion_part": CONVERSION_PART, "markdown_output": MARKDOWN_OUTPUT}
#: What an absent column of an older snapshot stands for; other absent columns are null.
DEFAULTS = {"part_count": 1, "parts_completed": 0, "attempt": 1, "split_depth": 0}


def struct(table: str) -> StructType:
    return _parse_datatype_string(TABLES[table])


def conform(old: DataFrame, table: str) -> DataFrame:
    """S3: an older snapshot in the current schema; every row stays, absent columns take their defaults."""
    have = {c.lower() for c in old.columns}
    columns = []
    for field in struct(table):
        default = F.lit(DEFAULTS.get(field.name))
        value = F.coalesce(F.col(field.name), default) if field.name in have and field.name in DEFAULTS else F.col(field.name) if field.name in have else default
        columns.append(value.cast(field.dataType).alias(field.name))
    return old.select(*columns)
