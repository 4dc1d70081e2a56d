"""The entry file where parts are missing, and queries from another folder."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
BLOCK = """
import sys
sys.path.insert(0, {repo!r})
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
names = set(entry.queries())
assert names and set(entry.oracle_sql()) <= names
print(len([n for n in names if n.startswith("op")]), len(names) > 90)
"""
STREAM = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", {own!r}).getOrCreate()
print(entry.queries()["x2_overdue_stream"](spark, "/root/testdata/sf0.001").count() > 0)
"""


def run(code, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=200)


def test_other_queries_stay_where_the_subpackage_cannot_be_imported(tmp_path):
    done = run(BLOCK.format(repo=str(REPO), blocked=["xxhash", "public_tokenizers"]), tmp_path)
    assert done.stdout.split() == ["0", "True"] and "left out" in done.stderr, done.stderr


def test_streams_run_from_any_folder(tmp_path):
    done = run(STREAM.format(repo=str(REPO), own=str(tmp_path)), tmp_path)
    assert done.stdout.strip() == "True", done.stderr[-2000:]
