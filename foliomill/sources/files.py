"""Scanning folders of uploads and expectation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column

from foliomill import schemas, states

HEAD_BYTES, TAIL_BYTES = 1024, 8192


def scan_uploads(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = states.MAX_UPLOAD_BYTES) -> DataFrame:
    """Path, filename, size_bytes, content_hash, head, tail and content of each file under path.

    Sizes are told first: of a file over max_bytes, of any size, nothing is read, and its hash, head,
    tail and content are null. Empty files have no seen_at. Columns that a query does not use are not kept.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    # the bound on length reaches the scan, which opens no file beyond it
    large = found.where(F.col("length") > max_bytes).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    files = found.where(F.col("length") <= max_bytes).unionByName(large)
    files = files.unionByName(empty_files(found).select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit("").cast("binary").alias("content")))
    size = F.octet_length("content")
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("modificationTime").alias("seen_at"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("content_hash"),
        F.substring("content", 1, HEAD_BYTES).alias("head"),
        F.col("content").substr(F.greatest(size - TAIL_BYTES + 1, F.lit(1)), F.lit(TAIL_BYTES)).alias("tail"),
        "content",
    )


def empty_files(found: DataFrame) -> DataFrame:
    """(path) of the files without content among those of a file scan, which list them but give no row.

    The scan's own list becomes a table inside Spark, and what it gives rows for is taken away from it.
    """
    spark = found.sparkSession
    listed = Column(spark._jvm.org.apache.spark.sql.functions.lit(found._jdf.inputFiles()))  # an array that stays in the JVM
    names = spark.range(1).select(F.explode(listed).alias("name"))
    left = names.join(found.select(F.input_file_name().alias("name")), "name", "left_anti")
    return left.select(F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B"))).alias("path"))


def scan_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A registry table with its fixed schema; nothing is inferred."""
    return spark.read.schema(schemas.struct(table)).parquet(path)


#: Columns by which single rows of the registry's tables are looked up; files are sorted by the first.
LOOKUPS = {
    "batch": ["id"],
    "source_document": ["content_hash"],
    "conversion_job": ["id", "content_hash", "output_filename", "batch_id"],
    "conversion_part": ["job_id", "id"],
    "markdown_output": ["output_filename", "content_hash", "job_id"],
}


def write_table(rows: DataFrame, path: str, table: str, distinct: int = 1_000_000, mode: str = "errorifexists") -> None:
    """Writes a registry table so that a lookup by key reads few row groups.

    Each file is sorted by the first key and has Bloom filters of all of them, sized for so many distinct
    values in a row group; filters of list_jobs and the like reach both.
    """
    keys = LOOKUPS[table]
    writer = rows.sortWithinPartitions(keys[0]).write.mode(mode)
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct))
    writer.parquet(path)


def scan_expectations(spark: SparkSession, path: str) -> DataFrame:
    """Expectations from JSON lines; counts default to 0, lists to empty, pages that are no integer to null."""
    rows = spark.read.schema(schemas.EXPECTATION).json(path)
    return conform_expectations(rows)


def conform_expectations(rows: DataFrame) -> DataFrame:
    """S4 for rows already read."""
    empty = F.array().cast("array<string>")
    return rows.select(
        "file",
        F.coalesce("traits", empty).alias("traits"),
        F.col("pages").try_cast("int").alias("pages"),
        *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ("headings", "tables", "figures")],
        F.coalesce("must_contain", empty).alias("must_contain"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )
