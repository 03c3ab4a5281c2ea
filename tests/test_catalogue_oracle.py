"""Every catalogue query against its DuckDB oracle (sf0.001, whole tables,
exact values: floats compared without rounding)."""

import os
import tempfile

import duckdb
import pytest

import __spark_entry__ as entry
from sqlrun import catalog
from tools.oracle_compare import compare, duck

from .conftest import SF_SMALL

entry.queries()  # loads the catalogue
QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    if name not in ORACLES:
        assert df.count() >= 1
        return
    assert compare(df, con, ORACLES[name], strict=True) == []


@pytest.fixture(scope="module")
def untyped(spark):
    """A folder whose `events` hold null event types."""
    from pyspark.sql import functions as F
    out = tempfile.mkdtemp(prefix="sqlrun-test-")
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    kind = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    events.withColumn("event_type", kind).coalesce(1).write.parquet(f"{out}/all")
    os.link(next(f"{out}/all/{f}" for f in os.listdir(f"{out}/all") if f.endswith(".parquet")),
            f"{out}/events.parquet")
    return out


@pytest.mark.parametrize("name", ["scan_schema_evolution", "scan_widen_bigint_double", "scan_widen_int_string",
                                  "scan_mixed_depth", "scan_partition_overlap"])
def test_rows_without_an_event_type_stay(spark, untyped, name):
    df = QUERIES[name](spark, untyped)
    assert df.filter("event_type IS NULL").count() > 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{untyped}/events.parquet')")
    assert compare(df, con, ORACLES[name], strict=True) == []


def test_entry_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "person", "n_events"]
    rows = df.collect()
    assert 0 < len(rows) <= 100
    counts = [r.n_events for r in rows]
    assert counts == sorted(counts, reverse=True)
