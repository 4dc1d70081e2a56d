"""Writing outputs per document, and upserting rows by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Marks rows that say that a key is gone.
TOMBSTONE = "__gone"


def read_outputs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What replace_outputs has stored under path, of each document its last set; nothing where there is none."""
    folders, _ = _batches(spark, path)
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*folders)
    if len(folders) == 1:
        return rows
    rows = rows.withColumn("__set", _written())
    last = rows.groupBy("content_hash").agg(F.max("__set").alias("__last"), F.min("__set").alias("__first"))
    stale = last.where("__first < __last").select("content_hash", "__last")  # documents that were stored again
    return rows.join(stale, "content_hash", "left").where("__last IS NULL OR __set = __last").select(*schema.names)


def replace_outputs(new: DataFrame, path: str) -> DataFrame:
    """Stores the outputs of the documents in new, instead of what path holds of these documents.

    Each call writes one set, which Spark's commit publishes as a whole: until then, and if the job fails,
    readers see the earlier sets of all documents. Nothing stored is written again; compact_outputs folds
    sets together now and then. One writer at a time. Returns files and bytes per document.
    """
    _, last = _batches(new.sparkSession, path)
    new.write.mode("overwrite").parquet(f"{path}/batch-{last + 1:012d}")
    return new.groupBy("content_hash").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


def compact_outputs(spark: SparkSession, path: str, schema: StructType) -> None:
    """Writes the last set of each document into one folder, which takes the place of all sets so far."""
    _fold(spark, path, lambda: read_outputs(spark, path, schema))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that this module made."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old and new rows, of each key the one with the latest version; on a tie the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new")))
    return both.withColumn("__nth", nth).where("__nth = 1").drop("__nth", "__new")


def upsert_table(new: DataFrame, path: str, number: int) -> None:
    """S8 on a table under path: adds batch number of changed rows. Writing a batch again replaces it.

    Only the changed rows are written; read_table keeps the latest of each key, and compact_table folds
    batches together now and then.
    """
    new.write.mode("overwrite").parquet(f"{path}/batch-{number:012d}")


def _batches(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """The folders that hold the table: the last fold that was written whole and all batches after it, and the last number."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return [], -1
    done = [s.getPath().getName() for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    found = {kind: sorted(int(n.split("-")[1]) for n in done if n.startswith(kind)) for kind in ("fold", "batch")}
    start = max(found["fold"], default=-1)
    later = [n for n in found["batch"] if n > start]
    return [*([f"{path}/fold-{start:012d}"] if start >= 0 else []), *[f"{path}/batch-{n:012d}" for n in later]], max([start, *later])


def _written() -> Column:
    """The number of the folder that a row comes from."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/(?:fold|batch)-(\d+)/[^/]*$", 1).cast("long")


def read_table(spark: SparkSession, path: str, keys: list[str], version: str, schema: str | None = None) -> DataFrame:
    """Of each key the row with the latest version; on a tie the one written last. Keys whose latest row is a tombstone are gone.

    Rows are dealt by key first, as what an aggregation of whole rows sorts where it reads them has no bound
    but the size of a file's split. Without any batch the table is empty and needs its schema.
    """
    folders, _ = _batches(spark, path)
    if not folders:
        return spark.createDataFrame([], schema or "")
    read = spark.read.schema(f"{schema}, {TOMBSTONE} boolean") if schema else spark.read.option("mergeSchema", True)
    rows = read.parquet(*folders)
    order = F.struct(F.col(version).alias("version"), _written().alias("written"))
    last = rows.withColumn("__order", order).repartition(*keys).groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col("__order")).alias("__row")).select("__row.*")
    return last.where(F.col(TOMBSTONE).isNull()).drop(TOMBSTONE) if TOMBSTONE in rows.columns else last


def delete_keys(gone: DataFrame, path: str, number: int) -> None:
    """J6, X11 on a stored table: adds batch number of tombstones for the rows of gone (keys and version), so that nothing is written again.

    A tombstone holds against rows of its version and earlier ones; compact_table leaves both out.
    """
    upsert_table(gone.withColumn(TOMBSTONE, F.lit(True)), path, number)


def next_batch(spark: SparkSession, path: str) -> int:
    """The number of the batch after the last that is whole."""
    return _batches(spark, path)[1] + 1


def compact_table(spark: SparkSession, path: str, keys: list[str], version: str, schema: str | None = None) -> None:
    """Writes the table as it is into one folder, which takes the place of all batches so far."""
    _fold(spark, path, lambda: read_table(spark, path, keys, version, schema))


def _fold(spark: SparkSession, path: str, whole: Callable[[], DataFrame]) -> None:
    """Folds what whole reads into one folder. What it replaces goes with the next fold only, as readers may have planned on it."""
    folders, last = _batches(spark, path)
    if len(folders) < 2:
        return
    whole().write.mode("overwrite").parquet(f"{path}/fold-{last:012d}")
    before = max((int(f.rsplit("-", 1)[1]) for f in folders if "/fold-" in f), default=-1)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    for entry in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder):
        kind, _, number = entry.getPath().getName().partition("-")
        if kind in ("fold", "batch") and (int(number), kind) < (before, "fold"):
            drop_folder(spark, f"{path}/{kind}-{number}")
