"""Intake: validating, hashing, converging and gating a batch of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import states
from foliomill.functions.status import size_plain


def rejection(filename: Column, head: Column, tail: Column, size: Column, max_bytes: int = states.MAX_UPLOAD_BYTES) -> Column:
    """Why a file is refused, the first rule that holds; null if it is accepted. head and tail are binary."""
    quoted = F.concat(F.lit('"'), filename, F.lit('"'))
    limit = size_plain(F.lit(max_bytes).cast("long"))
    # The sentences.
    return (
        F.when(size > max_bytes, F.concat(quoted, F.lit(" is larger than the "), limit, F.lit(" this converter accepts.")))
        .when(size == 0, F.concat(quoted, F.lit(" is empty — there is nothing to convert.")))
        .when(~F.contains(head, F.lit("%PDF-").cast("binary")), F.lit("Not a PDF. Only PDF files can be converted."))
        .when(F.contains(tail, F.lit("/Encrypt").cast("binary")), F.concat(quoted, F.lit(" is password-protected, so its contents cannot be read. Remove the password and upload it again.")))
    )


def page_rejection(filename: Column, pages: Column, encrypted: Column, max_pages: int = states.MAX_TOTAL_PAGES) -> Column:
    """Why a page count is refused; null if it is accepted. Null pages or fewer than one are unreadable."""
    quoted = F.concat(F.lit('"'), filename, F.lit('"'))
    # The sentences.
    many = F.concat(quoted, F.lit(" has "), F.format_number(pages, 0), F.lit(f" pages, more than the {max_pages:,} this converter accepts in one document. Split it into smaller files and upload those."))
    return (
        F.when(F.coalesce(encrypted, F.lit(False)), F.concat(quoted, F.lit(" is password-protected, so its contents cannot be read. Remove the password and upload it again.")))
        .when(F.coalesce(pages < 1, F.lit(True)), F.concat(quoted, F.lit(" could not be read — the file looks damaged or incomplete. Try re-saving or re-exporting it, then upload it again.")))
        .when(pages > max_pages, many)
    )


def content_hash(content: Column) -> Column:
    """Lower-case hex SHA-256 of the content."""
    return F.sha2(content, 256)


def division(pages: Column, part_count: Column, max_pages: int = states.PART_MAX_PAGES) -> Column:
    """Whole or split."""
    return F.when((part_count > 1) | F.coalesce(pages > max_pages, F.lit(False)), F.lit("split")).otherwise(F.lit("whole"))


def converge_documents(uploads: DataFrame) -> DataFrame:
    """A5: one row per content_hash of uploads (content_hash, filename, size_bytes, page_count, inbox_path, seen_at, seq).

    The first upload gives name, size and time; path and page count are the last that are not null.
    One shuffle with partial aggregation, so a hash that many uploads share is reduced where it is read.
    """
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return uploads.groupBy("content_hash").agg(
        F.min_by("filename", "seq").alias("original_filename"),
        F.min_by("size_bytes", "seq").alias("size_bytes"),
        F.min_by("seen_at", "seq").alias("first_seen_at"),
        last("page_count"),
        last("inbox_path"),
    )


def batch_intake(uploads: DataFrame) -> DataFrame:
    """Per batch_id how many files were accepted and rejected (uploads: batch_id, filename, reason)."""
    fine = F.col("reason").isNull()
    return uploads.groupBy("batch_id").agg(F.count_if(fine).alias("document_count"), F.count_if(~fine).alias("rejected_count"))


def intake_files(uploads: DataFrame) -> DataFrame:
    """The files of batch_intake, as rows, so that a batch may have any number: batch_id, filename, accepted, reason."""
    return uploads.select("batch_id", "filename", F.col("reason").isNull().alias("accepted"), "reason")
