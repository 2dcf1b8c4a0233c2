"""Queries with Python workers in a fresh process that has the package on no worker's path."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {tmp!r}).getOrCreate()
known = e.queries()
for name in {names!r}:
    if name in known:
        print(name, known[name](spark, {data!r}).count())
"""


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
def test_workers_need_no_path(tmp_path):
    names = ["ext21_waybill_rows", "spl05_sections", "udf16_field_scores", "op2_simhash_near_dedup"]
    code = RUN.format(root=str(ROOT), tmp=str(tmp_path / "c"), names=names, data=DATA)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) >= 6


def test_queries_are_listed_without_a_session():
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); import __spark_entry__ as e; print(len(e.queries()) > 250, set(e.oracle_sql()) <= set(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=False)
    assert done.stdout.split() == ["True", "True"], done.stderr[-2000:]
