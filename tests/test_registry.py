"""Lookups by key, and details of documents with very many jobs and outputs."""

import pytest
from pyspark.sql import functions as F

from foliomill import schemas
from foliomill.operators import registry
from foliomill.sources import files


def rows_scanned(frame):
    """Rows that left the scan, and the filters that reached it."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    text = plan.toString()
    if "AdaptiveSparkPlan" in text.splitlines()[0]:
        plan = plan.executedPlan()
        while plan.children().size():
            plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value(), plan.toString()


@pytest.mark.parametrize("key", ["id", "content_hash", "output_filename"])
def test_lookups_skip_row_groups(spark, tmp_path, key):
    n = 40_000
    jobs = spark.range(n).select(F.concat(F.lit("job-"), F.md5(F.col("id").cast("string"))).alias("id"), F.sha2((F.col("id") % 9000).cast("string"), 256).alias("content_hash"), F.concat(F.sha1(F.col("id").cast("string")), F.lit(".md")).alias("output_filename"))
    path = f"file://{tmp_path}/jobs"
    spark.conf.set("parquet.block.size", str(64 << 10))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(64 << 10))
    try:
        files.write_table(schemas.conform(jobs, "conversion_job").coalesce(2), path, "conversion_job", 1000)
    finally:
        spark.conf.unset("parquet.block.size")
        hadoop.unset("parquet.block.size")
    table = files.scan_table(spark, path, "conversion_job")
    wanted = jobs.select(key).orderBy(key).first()[key]
    look = {"id": lambda v: registry.list_jobs(table, job_id=v), "content_hash": lambda v: registry.list_jobs(table, content_hash=v), "output_filename": lambda v: table.where(F.col("output_filename") == v)}[key]
    scanned, plan = rows_scanned(look(wanted))
    assert 1 <= scanned < n / 2 and f"EqualTo({key}," in plan
    assert rows_scanned(look("m" + wanted[1:]))[0] < n / 20  # no such value: nearly no row group is opened


def test_details_are_linear_for_a_hot_document(spark):
    n = 100_000
    jobs = spark.range(n).select(F.concat(F.lit("j"), F.col("id").cast("string")).alias("id"), F.lit("hot").alias("content_hash"))
    outputs = spark.range(n).select(
        F.lit("hot").alias("content_hash"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("output_filename"), F.col("id").cast("int").alias("section_ordinal"), F.concat(F.lit("j"), (F.col("id") % 1000).cast("string")).alias("job_id")
    )
    details = registry.output_details(jobs, outputs)
    told = details.agg(F.count("*"), F.sum(F.size("positions")), F.max(F.size("positions"))).first()
    assert tuple(told) == (n, n, 100)
    assert details.where("id = 'j7'").first().positions == [8 + 1000 * k for k in range(100)]


def test_every_job_tells_the_names_of_its_document(spark):
    """The registered query gives each job its document's whole list, also jobs that share a document."""
    from foliomill.plans.derived import Derived
    from foliomill.plans.registry_queries import QUERIES

    sf = "/root/testdata/sf0.001"
    found = {r.id: r for r in QUERIES["j3_output_details"](spark, sf).collect()}
    tables = Derived(spark, sf)
    outputs = {}
    for o in tables.outputs.collect():
        outputs.setdefault(o.content_hash, []).append(o)
    jobs = tables.jobs.select("id", "content_hash").collect()
    assert len(found) == len(jobs) and len({j.content_hash for j in jobs}) < len(jobs)
    for j in jobs:
        mine = sorted(outputs.get(j.content_hash, []), key=lambda o: (o.section_ordinal or 0, o.output_filename))
        got = found[j.id]
        assert (got.own, got.every, got.names) == (sum(o.job_id == j.id for o in mine), len(mine), ",".join(o.output_filename for o in mine))
