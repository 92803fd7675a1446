"""Queries whose executors are processes of their own."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

RUN = """
import json, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "600m").getOrCreate()
from weftgraph.plans.catalogue import QUERIES
print("ROWS", json.dumps(sorted(map(list, QUERIES[sys.argv[1]](spark, sys.argv[2]).collect()))))
spark.stop()
"""


@pytest.mark.parametrize(("name", "region"), [("src_jdbc", 2), ("src_sql", 1)])
def test_databases_are_read_by_executors(sf, tmp_path, name, region):
    home = tmp_path / "home"  # where workers keep their folders
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_HOME": str(home)}
    got = subprocess.run([sys.executable, "-c", RUN, name, sf], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    rows = next((json.loads(line[5:]) for line in got.stdout.splitlines() if line.startswith("ROWS ")), got.stderr[-2000:])
    assert rows == [[k, f"NATION_{k}"] for k in range(region, 25, 5)]
