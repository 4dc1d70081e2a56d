"""Registry tables and Markdown derived from the test tables, in Spark and as DuckDB CTEs of the same text."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-03-01 00:00:00"

DOCUMENT = """
SELECT sha2(text, 256) AS content_hash, min_by(concat(source, '-', doc_id, '.pdf'), doc_id) AS original_filename,
       CAST(max(n_chars) AS BIGINT) AS size_bytes, CAST(max((n_chars + 1799) div 1800) AS INT) AS page_count,
       TIMESTAMP_NTZ '2024-01-01 00:00:00' + min(doc_id) * INTERVAL '1' MINUTE AS first_seen_at,
       CASE WHEN min(doc_id) % 3 <> 0 THEN concat('/inbox/', sha2(text, 256), '.pdf') END AS inbox_path,
       min(doc_id) AS first_doc
FROM {documents} GROUP BY sha2(text, 256)"""

JOB = """
SELECT concat('job-', event_id) AS id, concat('batch-', user_id) AS batch_id, content_hash, submitted_filename, status,
       CASE WHEN status IN ('submitted', 'running') THEN concat('task-', event_id) END AS engine_task_id,
       CAST(NULL AS INT) AS queue_position, ts AS created_at,
       CASE WHEN event_id % 10 > 2 THEN ts + INTERVAL '5' MINUTE WHEN event_id % 10 > 1 THEN ts + INTERVAL '30' SECOND ELSE ts END AS updated_at,
       CASE WHEN event_id % 10 > 1 THEN ts + INTERVAL '30' SECOND END AS started_at,
       CASE WHEN event_id % 10 > 2 THEN ts + INTERVAL '5' MINUTE END AS ended_at,
       CAST(1 + event_id % 9 AS INT) AS attempt,
       CASE WHEN status = 'failed' THEN 'the file looks damaged' WHEN status = 'timed_out' THEN 'took too long' END AS failure_reason,
       CASE WHEN status IN ('succeeded', 'succeeded_suspect', 'succeeded_incomplete', 'already_converted') THEN concat('doc--', substr(content_hash, 1, 12), '.md') END AS output_filename,
       CAST(greatest(1, (pages + 1) div 2) AS INT) AS part_count, CAST((pages + 1) div 4 AS INT) AS parts_completed,
       CASE WHEN status = 'succeeded_incomplete' THEN RANGES END AS missing_page_ranges, pages, event_id
FROM (SELECT e.event_id, e.user_id, e.ts, sha2(d.text, 256) AS content_hash, concat(d.source, '-', d.doc_id, '.pdf') AS submitted_filename,
             CAST((d.n_chars + 1799) div 1800 AS INT) AS pages,
             CASE e.event_id % 10 WHEN 0 THEN 'queued' WHEN 1 THEN 'submitted' WHEN 2 THEN 'running' WHEN 3 THEN 'succeeded_suspect'
                  WHEN 4 THEN 'succeeded_incomplete' WHEN 5 THEN 'already_converted' WHEN 6 THEN 'failed' WHEN 7 THEN 'timed_out' ELSE 'succeeded' END AS status
      FROM {events} e JOIN {documents} d ON d.doc_id = e.event_id % (SELECT count(*) FROM {documents})) x"""

PART = """
SELECT concat(id, '-', ordinal) AS id, id AS job_id, ordinal, first_page, CAST(least(first_page + 1, pages) AS INT) AS last_page, CAST(NULL AS VARCHAR) AS part_path,
       CASE (event_id div 7 + ordinal) % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'submitted' WHEN 2 THEN 'running' WHEN 3 THEN 'succeeded' WHEN 4 THEN 'failed' ELSE 'timed_out' END AS status,
       CAST(NULL AS VARCHAR) AS engine_task_id,
       CASE WHEN (event_id div 7 + ordinal) % 6 = 3 THEN concat('Pages ', first_page, ' of ', id) END AS markdown,
       CASE (event_id div 7 + ordinal) % 6 WHEN 4 THEN 'damaged' WHEN 5 THEN 'too slow' END AS failure_reason,
       created_at, CASE WHEN (event_id div 7 + ordinal) % 6 > 0 AND ordinal % 2 = 1 THEN created_at + INTERVAL '10' SECOND END AS started_at, CAST(NULL AS TIMESTAMP_NTZ) AS ended_at,
       CAST(1 + ordinal % 4 AS INT) AS attempt, CAST(ordinal % 3 AS INT) AS split_depth
FROM (SELECT id, pages, event_id, created_at, CAST(first_page AS INT) AS first_page, CAST((first_page + 1) div 2 AS INT) AS ordinal
      FROM (SELECT id, greatest(pages, 1) AS pages, event_id, created_at, SERIES(1, greatest(pages, 1), 2) AS first_page FROM {jobs}) y) x"""

OUTPUT = """
SELECT CASE WHEN first_doc % 3 = 0 THEN concat('doc--', substr(content_hash, 1, 12), '.md') ELSE concat('doc--', substr(content_hash, 1, 12), '--00', n, '-section.md') END AS output_filename,
       content_hash, concat('job-', first_doc) AS job_id, size_bytes * n AS bytes, first_seen_at + INTERVAL '31' DAY AS written_at,
       CASE WHEN first_doc % 7 = 0 THEN 'partial_success' ELSE 'success' END AS engine_status,
       CAST(CASE WHEN first_doc % 3 > 0 THEN n END AS INT) AS section_ordinal, CASE WHEN first_doc % 3 > 0 THEN concat('Part ', n) END AS section_title
FROM (SELECT content_hash, first_doc, size_bytes, first_seen_at, SERIES(1, 1 + first_doc % 3, 1) AS n FROM {source_documents}) x"""

MARKDOWN = """
SELECT doc_id, concat('# Doc ', doc_id, chr(10), chr(10),
  regexp_replace(regexp_replace(regexp_replace(text,
    '(?m)^([A-D])', '## $1'GLOBAL),
    '(?m)^([E-H])', concat('| a | b |', chr(10), '| --- | --- |', chr(10), '| x | $1')GLOBAL),
    '(?m)^([I-L])', concat('![fig](f.png)', chr(10), '$1')GLOBAL)) AS markdown, text, source, n_chars
FROM {documents}"""


def _spark(sql: str) -> str:
    sql = sql.replace("RANGES", "array(named_struct('first_page', 1, 'last_page', 2), named_struct('first_page', 5, 'last_page', 5))")
    return sql.replace("SERIES(", "explode(SERIES(").replace("SERIES(1, greatest(pages, 1), 2)", "sequence(1, greatest(pages, 1), 2))").replace("SERIES(1, 1 + first_doc % 3, 1)", "sequence(1, 1 + first_doc % 3, 1))").replace("GLOBAL", "").replace("VARCHAR", "STRING")


def _duck(sql: str) -> str:
    sql = sql.replace("RANGES", "[{'first_page': 1, 'last_page': 2}, {'first_page': 5, 'last_page': 5}]").replace("sha2(text, 256)", "sha256(text)").replace("sha2(d.text, 256)", "sha256(d.text)")
    sql = sql.replace("TIMESTAMP_NTZ", "TIMESTAMP").replace(" div ", " // ").replace("SERIES(1, greatest(pages, 1), 2)", "unnest(range(1, greatest(pages, 1) + 1, 2))").replace("SERIES(1, 1 + first_doc % 3, 1)", "unnest(range(1, 2 + first_doc % 3, 1))")
    sql = sql.replace("GLOBAL", ", 'g'").replace("$1", "\\1")
    for name, table in (("documents", "documents"), ("events", "events"), ("jobs", "conversion_job"), ("source_documents", "source_document")):
        sql = sql.replace("{" + name + "}", table)
    return sql


#: The derived tables for DuckDB; events get the number of their document first, so that the join with it is plain.
TABLES = {
    "source_document": _duck(DOCUMENT),
    "keyed_event": "SELECT e.*, e.event_id % c.n AS document FROM events e, (SELECT count(*) AS n FROM documents) c",
    "conversion_job": _duck(JOB).replace("FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)", "FROM keyed_event e JOIN documents d ON d.doc_id = e.document"),
    "conversion_part": _duck(PART),
    "markdown_output": _duck(OUTPUT),
    "markdown_doc": _duck(MARKDOWN),
}


def with_tables(sql: str) -> str:
    """A DuckDB query with the derived tables that it names before it; sql may begin with further tables, after a comma."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in set(re.findall(r"\w+", text)) & (set(TABLES) - needed):
            needed.add(name)
            need(TABLES[name])

    need(sql)
    tables = ", ".join(f"{name} AS MATERIALIZED ({TABLES[name]})" for name in TABLES if name in needed)
    body = sql.strip()
    if body.startswith(","):
        return f"WITH {tables}{body}" if tables else f"WITH {body[1:]}"
    return f"WITH {tables} {body}" if tables else body


class Derived:
    """The derived tables over one folder of test tables; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.spark.sql(_spark(DOCUMENT), documents=self.table("documents"))

    @cached_property
    def jobs(self) -> DataFrame:
        # the count as a literal: a subquery in a join's condition is not evaluated in time
        count = self.table("documents").count()
        sql = _spark(JOB).replace("(SELECT count(*) FROM {documents})", str(max(1, count))).replace("sha2(d.text, 256)", "d.content_hash")
        # texts are hashed before the join, so that it moves hashes and no texts
        hashed = self.table("documents").selectExpr("doc_id", "source", "n_chars", "sha2(text, 256) AS content_hash")
        return self.spark.sql(sql, documents=hashed, events=self.table("events"))

    @cached_property
    def parts(self) -> DataFrame:
        return self.spark.sql(_spark(PART), jobs=self.jobs)

    @cached_property
    def outputs(self) -> DataFrame:
        return self.spark.sql(_spark(OUTPUT), source_documents=self.documents)

    @cached_property
    def markdown(self) -> DataFrame:
        return self.spark.sql(_spark(MARKDOWN), documents=self.table("documents"))
