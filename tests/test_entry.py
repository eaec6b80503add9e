"""The driver's contract from a folder that isn't the repository's."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"

RUN = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
assert entry.entry(spark).count() > 0
queries = entry.queries()
assert set(entry.oracle_sql()) <= set(queries)
for name in ("drain_templates", "chunk_corpus"):
    assert queries[name](spark, {DATA!r}).count() > 0
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_runs_from_an_empty_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
