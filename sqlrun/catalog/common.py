"""Spec helpers shared by the catalogue."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..plans.runner import run
from . import fixtures as fx

# DuckDB side: the flat `events` table with the derived partition column.
DUCK_EV = ("ev AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date "
           "FROM events)")


# Customers' balances in the bands of suppliers' balances.
BANDS_DUCK = ("WITH s AS (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + CAST(33000 AS DOUBLE) / "
               "(SELECT COUNT(*) FROM supplier) AS hi FROM supplier) "
               "SELECT s.s_suppkey, COUNT(*) AS n, MIN(c.c_acctbal) AS least, MAX(c.c_custkey) AS last_key "
               "FROM customer c JOIN s ON c.c_acctbal >= s.lo AND c.c_acctbal < s.hi GROUP BY s.s_suppkey")


def flat(sf_dir: str, table: str, name: str | None = None) -> dict[str, Any]:
    return {"name": name or table, "path": f"{sf_dir}/{table}.parquet"}


def events_ds(spark: SparkSession, sf_dir: str, name: str = "ev",
              dates: list[Any] | None = None, types: list[Any] | None = None) -> dict[str, Any]:
    """Partition-listed `events` (by default every day and type in it)."""
    path = fx.events_by_day_type(spark, sf_dir)
    values = lambda col, given: fx.layout_values(spark, path, col) if given is None else list(given)
    return {"name": name, "path": path, "partitions": [
        {"key": "event_date", "values": values("event_date", dates)},
        {"key": "event_type", "values": values("event_type", types)}]}


# The flat `events` table with the derived day, as a view of the run.
EV_VIEW = {"name": "ev", "sql": "CREATE TEMPORARY VIEW ev AS "
           "SELECT *, CAST(CAST(ts AS DATE) AS STRING) AS event_date FROM events"}


def run_sql(spark: SparkSession, datasets: list[dict[str, Any]], query: str,
            **kw: Any) -> DataFrame:
    spec = {"datasets": datasets, "query": query}
    for k in ("views", "parameters", "args", "sparkSessionConfig"):
        if k in kw:
            spec[k] = kw.pop(k)
    return run(spark, spec, **kw).df


def tpch(sf_dir: str, *tables: str) -> list[dict[str, Any]]:
    return [flat(sf_dir, t) for t in tables]


def sql_list(values: list[Any]) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
