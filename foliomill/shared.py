"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_path(spark: SparkSession, tag: str, work: str | None = None) -> str:
    """A path that nothing uses yet: under work, or else the folder that spark.checkpoint.dir names.

    Only a local master may do without either; on a cluster each executor would write to its own disk.
    """
    named = work or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        named = "file://" + tempfile.mkdtemp(prefix="foliomill-")
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
