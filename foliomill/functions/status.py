"""What a job's state means and how it is told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill import states
from foliomill.functions.text import text_length

# What the states are called.
DISPLAY = {
    "queued": "Queued",
    "submitted": "Converting",
    "running": "Converting",
    "succeeded": "Converted",
    "succeeded_suspect": "Converted — check output",
    "succeeded_incomplete": "Converted — some pages are missing",
    "already_converted": "Already converted",
    "failed": "Failed",
    "timed_out": "Timed out",
}

# Keyword groups of failures, in order, and what the reader is told.
FAILURES = (
    (("password", "encrypt", "decrypt"), "This PDF is password-protected, so its contents could not be read. Remove the password and upload it again."),
    (("timeout", "timed out", "deadline"), "This document took too long to convert and was stopped. It may be very large or unusually complex."),
    (("too many pages", "max_num_pages", "file size", "too large"), "This document is larger than the converter accepts. Split it into smaller files and try again."),
    (("not valid", "not allowed", "policy"), "The converter would not accept this document. It may be protected, or saved in a form the converter cannot open — try re-exporting it as a PDF from the original application."),
    (("pdfium", "corrupt", "damaged", "malformed", "eof", "parse", "invalid pdf", "cannot read"), "This PDF could not be read — the file looks damaged or incomplete. Try re-saving or re-exporting it, then upload it again."),
    (("memory", "oom", "resource"), "The converter ran out of resources on this document. Try again later, or split the document into smaller files."),
    (("unsupported", "skipped", "not supported"), "The converter could not handle this document's contents. If it is a scan, try re-exporting it as a PDF from the original application."),
)
GENERIC_FAILURE = "This document could not be converted. Upload it again; if it fails a second time the PDF is probably damaged."


def page_ranges(ranges: Column, dash: str = "-") -> Column:
    """P22: "3, 7-9" of an array of (first_page, last_page)."""
    one = lambda r: F.when(r["first_page"] == r["last_page"], r["first_page"].cast("string")).otherwise(F.concat(r["first_page"].cast("string"), F.lit(dash), r["last_page"].cast("string")))
    return F.array_join(F.transform(ranges, one), ", ")


def display_status(status: Column, part_count: Column, parts_completed: Column, missing: Column) -> Column:
    """The state as a reader sees it; a split document says which part is on."""
    table = F.create_map(*[F.lit(x) for pair in DISPLAY.items() for x in pair])
    text = lambda c: c.cast("string")
    return (
        F.when(
            status.isin(*states.CONVERTING) & (part_count > 1),
            F.concat(F.lit("Converting — part "), text(F.least(parts_completed + 1, part_count)), F.lit(" of "), text(part_count)),
        )
        .when(
            (status == "queued") & (part_count > 1) & (parts_completed > 0),
            F.concat(F.lit("Queued — "), text(parts_completed), F.lit(" of "), text(part_count), F.lit(" parts already converted")),
        )
        .when((status == "succeeded_incomplete") & (F.size(missing) > 0), F.concat(F.lit("Converted — pages "), page_ranges(missing), F.lit(" are missing")))
        .otherwise(F.element_at(table, status))
    )


def failure_reason(errors: Column, engine_status: Column) -> Column:
    """P10: the first keyword group that the errors or the status mention decides."""
    said = F.concat(F.lower(F.concat_ws(" ", F.coalesce(errors, F.array().cast("array<string>")))), F.coalesce(F.concat(F.lit(" "), F.lower(F.nullif(engine_status, F.lit("")))), F.lit("")))
    out = None
    for words, message in FAILURES:
        hit = F.lit(False)
        for word in words:
            hit = hit | said.contains(word)
        out = F.when(hit, F.lit(message)) if out is None else out.when(hit, F.lit(message))
    return out.otherwise(F.lit(GENERIC_FAILURE))


def job_state(task_status: Column, engine_status: Column) -> Column:
    """The job state of an engine task; an unknown task status is an error."""
    fine = F.coalesce(engine_status.isin("success", "partial_success"), F.lit(False))
    return (
        F.when(task_status == "pending", F.lit("submitted"))
        .when(task_status == "started", F.lit("running"))
        .when(task_status == "failure", F.lit("failed"))
        .when(task_status == "success", F.when(fine, F.lit("succeeded")).otherwise(F.lit("failed")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown task status "), F.coalesce(task_status, F.lit("null")))))
    )


def is_suspect(markdown: Column, pages: Column, per_page: int = states.SUSPECT_CHARS_PER_PAGE, floor: int = states.SUSPECT_CHARS_FLOOR) -> Column:
    """Too little text for the pages."""
    return text_length(markdown) < F.when(pages > 0, pages * per_page).otherwise(F.lit(floor))


def outcome(suspect: Column, missing: Column) -> Column:
    """The state a converted document ends in."""
    return F.when(F.coalesce(F.size(missing) > 0, F.lit(False)), F.lit("succeeded_incomplete")).when(suspect, F.lit("succeeded_suspect")).otherwise(F.lit("succeeded"))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with one decimal, half to even on decimal milliseconds; null if either is."""
    millis = F.floor(F.unix_micros(end.cast("timestamp")) / 1000) - F.floor(F.unix_micros(start.cast("timestamp")) / 1000)
    return F.bround(millis.cast("decimal(20,0)") / F.lit(1000).cast("decimal(6,0)"), 1).cast("double")


def explanation(failure: Column, status: Column, engine_status: Column, missing: Column) -> Column:
    """P25: the whole sentence about an outcome."""
    # The sentences.
    gaps = F.concat(F.lit("Converted, but pages "), F.coalesce(page_ranges(missing, "–"), F.lit("")), F.lit(" are missing — those parts failed."))
    return (
        F.when(F.length(failure) > 0, failure)
        .when(status == "succeeded_suspect", F.lit("The Markdown came out almost empty. Open it before importing it."))
        .when(status == "succeeded_incomplete", gaps)
        .when(status == "already_converted", F.lit("This document was already converted earlier; the Markdown is in the output folder."))
        .when(engine_status == "partial_success", F.lit("Converted, but parts of the document could not be fully read."))
        .otherwise(F.lit("Converted."))
    )


def size_plain(value: Column) -> Column:
    """P20: whole MB, KB or bytes, halves to even."""
    mb, kb = F.bround(value / 1048576.0, 0).cast("long"), F.bround(value / 1024.0, 0).cast("long")
    return F.when(value >= 1048576, F.concat(mb.cast("string"), F.lit(" MB"))).when(value >= 1024, F.concat(kb.cast("string"), F.lit(" KB"))).otherwise(F.concat(value.cast("string"), F.lit(" bytes")))


def size_decimal(value: Column) -> Column:
    """P20: MB with one decimal (halves to even), whole KB (halves up) or bytes."""
    kb = F.floor(value / 1024.0 + 0.5).cast("long")
    return F.when(value >= 1048576, F.concat(F.format_string("%.1f", F.bround(value / 1048576.0, 1)), F.lit(" MB"))).when(value >= 1024, F.concat(kb.cast("string"), F.lit(" KB"))).otherwise(F.concat(value.cast("string"), F.lit(" bytes")))


def iso_millis(moment: Column) -> Column:
    """UTC with milliseconds and Z; a text without an offset is UTC."""
    return F.date_format(F.date_trunc("MILLISECOND", moment.cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_moment(text: Column) -> Column:
    """Any ISO-8601 text as a timestamp to the millisecond."""
    return F.date_trunc("MILLISECOND", F.to_timestamp(text))


def page_count_of(body: Column) -> Column:
    """The first positive integer among page_count, num_pages and pages, the document object first."""
    at = lambda path: F.get_json_object(body, path)
    whole = lambda path: F.when(at(path).rlike(r"^[0-9]+$") & (at(path).try_cast("long") > 0), at(path).try_cast("long"))
    return F.coalesce(*[whole(f"$.{where}{key}") for where in ("document.", "") for key in ("page_count", "num_pages", "pages")])


def decode_ranges(text: Column) -> Column:
    """[[1,2],[5,5]] as an array of structs; an empty list is null."""
    pairs = F.from_json(text, "array<array<int>>")
    return F.when(F.size(pairs) > 0, F.transform(pairs, lambda p: F.struct(p[0].alias("first_page"), p[1].alias("last_page"))))


def encode_ranges(ranges: Column) -> Column:
    """An array of structs as [[1,2],[5,5]]; empty becomes null."""
    return F.when(F.size(ranges) > 0, F.to_json(F.transform(ranges, lambda r: F.array(r["first_page"], r["last_page"]))))


def decode_errors(text: Column) -> Column:
    """A JSON list of strings; an empty one is null."""
    found = F.from_json(text, "array<string>")
    return F.when(F.size(found) > 0, found)
