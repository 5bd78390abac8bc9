"""The survivors on several executors, where the order of shuffled rows changes from run to run."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pyspark
import pytest

DIR = "/root/testdata/sf0.01"
SCRIPT = """
import json, sys
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local-cluster[2,2,1024]").config("spark.executor.memory", "768m").config("spark.sql.shuffle.partitions", "12")
     .config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.sql.files.maxPartitionBytes", "128k").config("spark.ui.enabled", "false")
     .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate())
s.sparkContext.setLogLevel("ERROR")
from spindrift.llm import survivor
for _ in range(3):
    print(json.dumps(sorted((r.group_id, r.filepath) for r in survivor.found(s, sys.argv[2]).collect())))
"""


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_survivors_do_not_depend_on_the_order_of_rows(tmp_path):
    from spindrift.llm.survivor import SQL

    con = duckdb.connect()
    for t in ("tracks", "group_members"):
        con.execute(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    want = sorted(con.sql(SQL).fetchall())
    home = tmp_path / "home"  # the executors' logs go to Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "shared"), DIR], capture_output=True, text=True, timeout=300, env=env)
    lines = run.stdout.strip().splitlines()
    assert len(lines) == 3, run.stderr[-2000:]
    for line in lines:
        assert [tuple(r) for r in json.loads(line)] == want
