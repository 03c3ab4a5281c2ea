"""Plan hygiene over the whole catalogue: no query plans a cartesian product
or a nested-loop join, and every partitioned `events` scan is a single
FileScan (no union of per-leaf scans)."""

import pytest

import __spark_entry__ as entry
from sqlrun import catalog

from .conftest import SF_SMALL

entry.queries()  # loads the catalogue
QUERIES = catalog.QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_join(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["scan_partition_product", "scan_partition_three_levels",
                                  "readme_top_users", "param_typed", "register_join"])
def test_partitioned_events_read_by_one_scan(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    event_scans = [ln for ln in plan.splitlines()
                   if "FileScan parquet" in ln and "events_by" in ln]
    assert len(event_scans) == 1
    assert "Union" not in plan


def test_flagship_prunes_partitions_and_columns(spark):
    plan = _plan(QUERIES["readme_top_users"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "ReadSchema: struct<user_id:bigint>" in plan
    assert "partial_count" in plan  # pre-aggregated before the join


def test_int_level_filter_prunes_folders(spark):
    plan = _plan(QUERIES["scan_hourly_profile"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(hour" in plan and "(hour#" in plan and ">= 9" in plan
    assert "ReadSchema: struct<user_id:bigint>" in plan
