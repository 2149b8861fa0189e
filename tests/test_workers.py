import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
from tablewright.catalog import QUERIES
assert len(QUERIES["silhouette_euclid"](spark, {sf!r}).collect()) == 1
assert len(QUERIES["correlation_matrix"](spark, {sf!r}).collect()) == 64
print("DONE")
"""


def test_python_workers_need_no_copy_of_the_package(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT, sf=sf)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert "DONE" in done.stdout, done.stderr[-2000:]
