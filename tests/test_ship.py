"""The package reaches workers that start in another folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
print("ROWS", entry.entry(spark).count(), entry.queries()["swings"](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    found = [line.split() for line in out.stdout.splitlines() if line.startswith("ROWS")]
    assert found and int(found[0][1]) > 0 and int(found[0][2]) > 0, out.stderr[-2000:]
