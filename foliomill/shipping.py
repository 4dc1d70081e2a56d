"""Making this package importable where Spark's Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Hands the package to the session's executors, once; Spark distributes the archive. Returns the session."""
    context = spark.sparkContext
    if not getattr(context, "_foliomill_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="foliomill-")) / "foliomill.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        # stateful processors are also loaded by a worker beside the driver, which added files do not reach
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [context.environment.get("PYTHONPATH"), str(archive)]))
        context._foliomill_shipped = True
    return spark
