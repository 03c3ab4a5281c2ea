"""Runtime confs that a run takes over, and launch confs of a spec that only
Spark can read."""

import json
import os
import subprocess
import sys

from sqlrun import run
from sqlrun.plans.runner import launch, launch_confs

from .conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SPEC = {"datasets": [{"name": "n", "path": f"{SF_SMALL}/nation.parquet"}], "query": "SELECT COUNT(*) AS n FROM n"}


def _conf(spark, key, *conf):
    return run(spark, {**SPEC, "sparkSessionConfig": dict(conf)}).session.conf.get(key, None)


def test_a_run_starts_with_the_callers_confs(spark):
    caller = spark.newSession()
    caller.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    caller.conf.set("spark.sql.adaptive.enabled", "false")
    caller.conf.set("custom.user.key", "mine")
    assert _conf(caller, "spark.sql.session.timeZone") == "Asia/Tokyo"
    assert _conf(caller, "custom.user.key") == "mine"
    # over the default profile, under the run's own map
    assert _conf(caller, "spark.sql.adaptive.enabled") == "false"
    assert _conf(caller, "spark.sql.adaptive.enabled", ("spark.sql.adaptive.enabled", "true")) == "true"
    assert _conf(caller, "spark.sql.session.timeZone", ("spark.sql.session.timeZone", "UTC")) == "UTC"
    # and what the run sets stays in it
    assert caller.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    assert _conf(spark.newSession(), "spark.sql.adaptive.enabled") == "true"


def test_launch_confs_are_those_that_a_running_session_lacks(spark):
    have = spark.sparkContext.getConf().get("spark.app.name")
    conf = {"spark.sql.warehouse.dir": "/elsewhere", "spark.sql.shuffle.partitions": "3", "spark.executor.memory": "2g",
            "spark.hadoop.fs.x": "1", "other.key": "1", "spark.app.name": have}
    assert set(launch_confs(spark, conf)) == {"spark.sql.warehouse.dir", "spark.executor.memory"}


def test_a_running_application_is_left_as_it_is(spark, scratch):
    with open(f"{scratch}/run.json", "w") as f:
        json.dump({**SPEC, "outputPrefix": scratch, "sparkSessionConfig": {"spark.sql.warehouse.dir": "/w"}}, f)
    got, spec = launch(f"file:{scratch}/run.jso[n]")  # a pattern, so that Spark reads it
    assert got is spark and spec.session_config == {"spark.sql.warehouse.dir": "/w"}


def test_static_confs_of_a_spec_that_spark_reads_take_effect(scratch):
    with open(f"{scratch}/run.json", "w") as f:
        json.dump({**SPEC, "outputPrefix": f"{scratch}/out", "sparkSessionConfig": {
            "spark.sql.warehouse.dir": f"file:{scratch}/warehouse", "spark.sql.shuffle.partitions": "3"}}, f)
    script = f"""
from pyspark.sql import SparkSession
from sqlrun.plans.runner import main
assert main(["file:{scratch}/run.jso[n]", "r1"]) == 0
spark = SparkSession.getActiveSession()
print("GOT", spark.conf.get("spark.sql.warehouse.dir"), spark.read.parquet("{scratch}/out/r1").first().n)
"""
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS":
           "--master local[1] --conf spark.ui.enabled=false --conf spark.ui.showConsoleProgress=false pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", script], env=env, cwd=scratch, capture_output=True, text=True, timeout=240)
    assert out.returncode == 0, out.stderr[-2000:]
    assert f"GOT file:{scratch}/warehouse 25" in out.stdout
