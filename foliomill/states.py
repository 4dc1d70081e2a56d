"""State sets and default settings that operators share."""

from __future__ import annotations

# The states of jobs, parts, engine results and engine tasks.
JOB_STATES = ("queued", "submitted", "running", "succeeded", "succeeded_suspect", "succeeded_incomplete", "already_converted", "failed", "timed_out")
PART_STATES = ("queued", "submitted", "running", "succeeded", "failed", "timed_out")
ENGINE_STATES = ("success", "partial_success", "skipped", "failure")
TASK_STATES = ("pending", "started", "success", "failure")

IN_FLIGHT = ("queued", "submitted", "running")
CONVERTING = ("submitted", "running")
TERMINAL = ("succeeded", "succeeded_suspect", "succeeded_incomplete", "already_converted", "failed", "timed_out")
DOWNLOADABLE = ("succeeded", "succeeded_suspect", "succeeded_incomplete", "already_converted")
TERMINAL_PART = ("succeeded", "failed", "timed_out")

# Settings that are part of the operators' meaning.
MAX_UPLOAD_BYTES = 209_715_200
JOB_TIMEOUT_SECONDS = 2700
INBOX_RETENTION_HOURS = 48
FAILED_RETENTION_DAYS = 14
JOB_HISTORY_DAYS = 30
SUSPECT_CHARS_PER_PAGE = 50
SUSPECT_CHARS_FLOOR = 200
PART_MAX_PAGES = 40
PART_RETRY_SPLITS = 2
PART_MIN_PAGES = 10
JOB_MAX_ATTEMPTS = 8
PART_MAX_ATTEMPTS = 3
MAX_TOTAL_PAGES = 10_000
PARTS_IN_FLIGHT = 2
SECTION_THRESHOLD_BYTES = 1_048_576
SECTION_MIN_BYTES = 16_384
SECTION_MAX_BYTES = 524_288
MAX_IN_FLIGHT = 3
RESTART_ALARM_COUNT = 3
RESTART_ALARM_SECONDS = 900
LIST_LIMIT = 100
LIST_LIMIT_MAX = 500
INVENTORY_LIMIT = 500
#: Into how many states the keys of a stream are dealt; fixed for the life of its checkpoint.
STREAM_BUCKETS = 1024
EVENTS = (
    "job_accepted", "job_retry_requested", "job_already_converted", "job_submitted", "job_running", "job_split", "job_reconciled",
    "job_recovered", "job_succeeded", "job_failed", "job_timed_out", "part_submitted", "part_succeeded", "part_failed",
    "part_requeued", "part_halved", "part_timed_out",
)
