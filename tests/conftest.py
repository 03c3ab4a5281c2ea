import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"
# The days and types of the given `events` table.
EVENT_DATES = [f"2024-01-{d:02d}" for d in range(1, 31)]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = (SparkSession.builder.master("local[4]").appName("sqlrun-tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    # Tests set their own checkpoint folder only where the session has none.
    if not session.conf.get("spark.checkpoint.dir", None) and not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sqlrun-test-ckpt-"))
    yield session


@pytest.fixture()
def scratch():
    """A fresh folder per test (never cleared, never reused)."""
    return tempfile.mkdtemp(prefix="sqlrun-test-")
