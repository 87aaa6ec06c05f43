"""Core and corpus queries in one application whose executors are processes of their own."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.checkpoint.dir", sys.argv[1]).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
sys.path.insert(0, sys.argv[2])
import __spark_entry__
queries = __spark_entry__.queries()
for name in ("kruskal_p", "op7_pii", "entropy_fallback", "op2_secrets"):
    assert queries[name](spark, "/root/testdata/sf0.001").count(), name
print("all four ran")
spark.stop()
"""


def test_core_and_corpus_queries_share_an_application(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # executors get the package by being sent it
    got = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), str(ROOT)], capture_output=True, text=True, timeout=300, env=env, cwd=tmp_path)
    assert "all four ran" in got.stdout, got.stderr[-2000:]
