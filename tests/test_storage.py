"""The shared folder: in a session that names none, on a cluster that names none, and its clearing."""

from __future__ import annotations

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from quantloom.storage import discard, materialise, scratch, shared_folder

WITHOUT = """
from pyspark.sql import SparkSession
from quantloom.storage import materialise, shared_folder
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert materialise(spark.range(5)).count() == 5
print("FOLDER", shared_folder(spark))
spark.stop()
"""


def test_a_session_without_the_setting_takes_its_own_folder_and_clears_it(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", WITHOUT], capture_output=True, text=True, timeout=120, check=True, env=env).stdout
    where = next(line.split()[1] for line in out.splitlines() if line.startswith("FOLDER"))
    path = where.removeprefix("file:")
    assert not [n for n in os.listdir(path) if n.startswith("quantloom-")] if os.path.isdir(path) else True


def test_a_cluster_without_the_setting_is_an_error():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_scratch_deletes_what_was_written_within(spark):
    with scratch():
        inner = materialise(spark.range(3))
        assert os.path.isdir(inner._written_to) and inner.count() == 3
        result = materialise(inner.selectExpr("id + 1 as id"), result=True)
    assert not os.path.isdir(inner._written_to) and result.count() == 3
    outer = materialise(spark.range(3))
    assert os.path.isdir(outer._written_to)
    discard(outer)
    assert not os.path.isdir(outer._written_to)


def test_buckets_need_no_shuffle(spark):
    rows = materialise(spark.range(100).selectExpr("id % 7 as k", "id"), by="k")
    plan = rows.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and rows.count() == 100
    discard(rows)
    assert not os.path.isdir(rows._written_to) and not spark.catalog.tableExists(rows._table)
