"""The cluster's shared folder for intermediate data.

``spark.checkpoint.dir`` names it.  Only a session in one local process may go
without: it then gets a temporary folder of its own.  On a cluster a missing
setting is an error, since a machine-local folder would be invisible to the
other executors.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    # The conf names the folder itself; getCheckpointDir() adds a
    # per-application sub-folder, which would defeat reuse across runs.
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: only the conf is visible
        sc = None
    current = current or (sc.getCheckpointDir() if sc is not None else None)
    if current:
        return current.rstrip("/")
    if sc is None or not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="sqlrun-checkpoint-")
    sc.setCheckpointDir(local)
    return (sc.getCheckpointDir() or local).rstrip("/")
