"""Queries exercising the library's own operators (scan, coverage, params,
view chain, override, sink).  Each goes through ``sqlrun.run``."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.range_join import range_join
from ..plans.runner import run
from ..sources.result_sink import manifest_summary, preview, read_ranked, read_result, write_result
from ..spec import RunSpec
from . import fixtures as fx
from . import register
from .common import BANDS_DUCK, DUCK_EV, events_ds, flat, run_sql, sql_list

D = "CAST(CAST(ts AS DATE) AS VARCHAR)"

# ----------------------------------------------------------------- scans
# The days, types and gaps that these specs list.
PRODUCT_DATES = [f"2024-01-{d:02d}" for d in range(1, 16)]
PRODUCT_TYPES = ["click", "purchase", "view"]


def _all_values(spark: SparkSession, path: str, *keys: str) -> list[dict]:
    return [{"key": k, "values": fx.layout_values(spark, path, k)} for k in keys]


@register("scan_flat", "SELECT * FROM nation")
def scan_flat(spark: SparkSession, sf: str):
    return run_sql(spark, [flat(sf, "nation")], "SELECT * FROM nation")


_PRODUCT_ORACLE = (
    f"SELECT *, {D} AS event_date FROM events "
    f"WHERE {D} IN ({sql_list(PRODUCT_DATES)}) AND event_type IN ({sql_list(PRODUCT_TYPES)})")


@register("scan_partition_product", _PRODUCT_ORACLE)
def scan_partition_product(spark: SparkSession, sf: str):
    ds = events_ds(spark, sf, dates=PRODUCT_DATES, types=PRODUCT_TYPES)
    return run_sql(spark, [ds], "SELECT * FROM ev")


@register("scan_partition_missing", _PRODUCT_ORACLE)
def scan_partition_missing(spark: SparkSession, sf: str):
    ds = events_ds(spark, sf, dates=PRODUCT_DATES + ["2099-01-01"],
                   types=PRODUCT_TYPES + ["no_such_type"])
    return run_sql(spark, [ds], "SELECT * FROM ev")


@register("scan_partition_duplicates",
          f"SELECT *, {D} AS event_date FROM events WHERE event_type IN ('click', 'view') "
          f"UNION ALL SELECT *, {D} AS event_date FROM events WHERE event_type = 'click'")
def scan_partition_duplicates(spark: SparkSession, sf: str):
    ds = events_ds(spark, sf, types=["click", "click", "view"])
    return run_sql(spark, [ds], "SELECT * FROM ev")


@register("scan_partition_typed",
          "SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders")
def scan_partition_typed(spark: SparkSession, sf: str):
    path = fx.orders_by_year(spark, sf)
    ds = {"name": "orders", "path": path,
          "partitions": [{"key": "o_year", "values": fx.layout_values(spark, path, "o_year") + [2099]}]}
    return run_sql(spark, [ds], "SELECT * FROM orders")


@register("scan_partition_nested",
          f"SELECT *, {D} AS event_date, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def scan_partition_nested(spark: SparkSession, sf: str):
    # only the first level is listed; `hour` below it is discovered (int)
    path = fx.events_by_day_hour(spark, sf)
    ds = {"name": "ev", "path": path,
          "partitions": [{"key": "event_date", "values": fx.layout_values(spark, path, "event_date")}]}
    return run_sql(spark, [ds], "SELECT * FROM ev")


# Fixed value: the data columns of the `events` files (DDL), as declared by a
# user who skips footer inference.
EVENTS_DDL = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, value DOUBLE, props STRING"


@register("scan_declared_schema", f"SELECT *, {D} AS event_date FROM events")
def scan_declared_schema(spark: SparkSession, sf: str):
    # declared data schema: no footer is read to plan the scan
    ds = {**events_ds(spark, sf), "schema": EVENTS_DDL}
    return run_sql(spark, [ds], "SELECT * FROM ev")


@register("scan_partition_three_levels",
          f"SELECT *, {D} AS event_date, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def scan_partition_three_levels(spark: SparkSession, sf: str):
    # days x hours x types in the data, thousands of listed leaves, in one scan
    path = fx.events_by_day_hour_type(spark, sf)
    ds = {"name": "ev", "path": path, "partitions": _all_values(spark, path, "event_date", "hour", "event_type")}
    return run_sql(spark, [ds], "SELECT * FROM ev")


@register("scan_hourly_profile",
          "SELECT CAST(hour(ts) AS INTEGER) AS hour, event_type, COUNT(*) AS n, "
          "COUNT(DISTINCT user_id) AS users FROM events WHERE hour(ts) BETWEEN 9 AND 17 "
          "GROUP BY 1, 2")
def scan_hourly_profile(spark: SparkSession, sf: str):
    # a filter on the int `hour` level prunes folders before any file opens
    path = fx.events_by_day_hour_type(spark, sf)
    ds = {"name": "ev", "path": path, "partitions": _all_values(spark, path, "event_date", "hour", "event_type")}
    return run_sql(spark, [ds], "SELECT hour, event_type, COUNT(*) AS n, "
                   "COUNT(DISTINCT user_id) AS users FROM ev "
                   "WHERE hour BETWEEN ${FROM_HOUR} AND ${TO_HOUR} GROUP BY hour, event_type",
                   parameters={"FROM_HOUR": 9, "TO_HOUR": 17})


@register("scan_partition_overlap", "SELECT * FROM events")
def scan_partition_overlap(spark: SparkSession, sf: str):
    path = fx.events_overlap(spark, sf)
    ds = {"name": "ev", "path": path, "partitions": _all_values(spark, path, "event_type")}
    return run_sql(spark, [ds], "SELECT * FROM ev")


@register("scan_schema_evolution",
          "SELECT event_id, ts, user_id, value, "
          f"CASE WHEN event_type IN ({sql_list(fx.OLD_SCHEMA_TYPES)}) THEN NULL ELSE props END "
          "AS props, event_type FROM events")
def scan_schema_evolution(spark: SparkSession, sf: str):
    path = fx.events_evolved(spark, sf)
    ds = {"name": "ev", "path": path, "partitions": _all_values(spark, path, "event_type")}
    return run_sql(spark, [ds], "SELECT * FROM ev")


_IS_OLD = f"event_type IN ({sql_list(fx.OLD_SCHEMA_TYPES)})"


@register("scan_widen_bigint_double",
          f"SELECT event_id, ts, user_id, CASE WHEN {_IS_OLD} THEN floor(value) ELSE value END AS value, "
          "props, event_type FROM events")
def scan_widen_bigint_double(spark: SparkSession, sf: str):
    path = fx.events_bigint_double(spark, sf)
    ds = {"name": "ev", "path": path, "partitions": _all_values(spark, path, "event_type")}
    return run_sql(spark, [ds], "SELECT * FROM ev")


@register("scan_widen_int_string", "SELECT event_id, ts, user_id, value, props, event_type FROM events")
def scan_widen_int_string(spark: SparkSession, sf: str):
    path = fx.events_int_string(spark, sf)
    ds = {"name": "ev", "path": path, "partitions": _all_values(spark, path, "event_type")}
    return run_sql(spark, [ds], "SELECT event_id, ts, CAST(user_id AS BIGINT) AS user_id, value, props, "
                   "event_type FROM ev")


@register("scan_mixed_depth",
          f"SELECT *, CASE WHEN {_IS_OLD} THEN NULL ELSE CAST(hour(ts) AS INTEGER) END AS hour FROM events")
def scan_mixed_depth(spark: SparkSession, sf: str):
    path = fx.events_mixed_depth(spark, sf)
    ds = {"name": "ev", "path": path, "partitions": _all_values(spark, path, "event_type")}
    return run_sql(spark, [ds], "SELECT * FROM ev")


@register("scan_many_roots",
          f"SELECT event_id, ts, user_id, value, CASE WHEN ["
          f"{sql_list(fx.SITES)}][CAST(event_id % {len(fx.SITES)} + 1 AS INTEGER)] IN ({sql_list(fx.SITES_WITHOUT_PROPS)}) "
          f"THEN NULL ELSE props END AS props, event_type, {D} AS event_date FROM events")
def scan_many_roots(spark: SparkSession, sf: str):
    # a glob as the base path: every site that holds a listed day, of two schemas
    path = fx.event_sites(spark, sf)
    ds = {"name": "ev", "path": f"{path}/sites/*",
          "partitions": [{"key": "event_date", "values": fx.layout_values(spark, path, "event_date") + ["2099-01-01"]}]}
    return run_sql(spark, [ds], "SELECT * FROM ev")


_SPOILED_ORACLE = (f"SELECT event_type, {D} AS event_date, COUNT(*) AS n, MAX(value) AS most FROM events "
                   f"WHERE {D} <> '{fx.SPOILED_DATE}' GROUP BY 1, 2")


def _spoiled(spark: SparkSession, sf: str, **how):
    path = fx.events_spoiled(spark, sf)
    days = sorted({*fx.layout_values(spark, path, "event_date"), fx.SPOILED_DATE})
    ds = {"name": "ev", "path": path, "partitions": [{"key": "event_date", "values": days}], **how}
    return run_sql(spark, [ds], "SELECT event_type, event_date, COUNT(*) AS n, MAX(value) AS most "
                   "FROM ev GROUP BY event_type, event_date")


@register("scan_unreadable_declared", _SPOILED_ORACLE)
def scan_unreadable_declared(spark: SparkSession, sf: str):
    # a day without a readable file is left out though no footer is read
    return _spoiled(spark, sf, schema=f"{EVENTS_DDL}, event_type STRING")


@register("scan_unreadable_leaf", _SPOILED_ORACLE)
def scan_unreadable_leaf(spark: SparkSession, sf: str):
    # the same by one footer for each day
    return _spoiled(spark, sf, schema_mode="leaf")


@register("scan_leaf_footers",
          f"SELECT event_id, ts, user_id, CASE WHEN {_IS_OLD} THEN NULL ELSE props END AS props, value, event_type "
          "FROM events")
def scan_leaf_footers(spark: SparkSession, sf: str):
    # INT and BIGINT leaves, one without a column: one scan by a footer a leaf
    path = fx.events_evolved(spark, sf)
    ds = {"name": "ev", "path": path, "schema_mode": "leaf", "partitions": _all_values(spark, path, "event_type")}
    return run_sql(spark, [ds], "SELECT * FROM ev")


# The days of a calendar that a filter leaves decide, while the query runs,
# which folders of the listed scan are read.
@register("scan_dynamic_pruning",
          f"SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, event_type, COUNT(*) AS n, MAX(value) AS most "
          f"FROM events WHERE dayofweek(ts) IN (0, 6) GROUP BY 1, 2")
def scan_dynamic_pruning(spark: SparkSession, sf: str):
    calendar = {"name": "calendar", "path": fx.event_calendar(spark, sf)}
    return run_sql(spark, [events_ds(spark, sf), calendar],
                   "SELECT c.weekday, e.event_type, COUNT(*) AS n, MAX(e.value) AS most FROM ev e "
                   "JOIN calendar c ON e.event_date = c.event_date WHERE c.weekday IN (1, 7) "
                   "GROUP BY c.weekday, e.event_type")


_LATER = f"ts + INTERVAL {fx.SHIFT_DAYS} DAY"


@register("scan_values_from_data",
          f"SELECT CAST(CAST({_LATER} AS DATE) AS VARCHAR) AS event_date, COUNT(*) AS n, "
          f"MAX({_LATER}) AS last_ts FROM events GROUP BY 1")
def scan_values_from_data(spark: SparkSession, sf: str):
    # the listed days are those that the layout holds, over the end of a month
    path = fx.events_shifted(spark, sf)
    ds = {"name": "ev", "path": path, "partitions": _all_values(spark, path, "event_date")}
    return run_sql(spark, [ds], "SELECT event_date, COUNT(*) AS n, MAX(ts) AS last_ts FROM ev GROUP BY event_date")


COVER_DATES = [f"2024-01-{d:02d}" for d in range(1, 31, 3)] + ["2099-01-01"]
COVER_TYPES = ["view", "click", "no_such_type"]


def _duck_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@register("partition_coverage",
          f"WITH req AS (SELECT CAST(i AS BIGINT) AS leaf_index, "
          f"{_duck_list(COVER_DATES)}[CAST(i // {len(COVER_TYPES)} AS INTEGER) + 1] AS event_date, "
          f"{_duck_list(COVER_TYPES)}[CAST(i % {len(COVER_TYPES)} AS INTEGER) + 1] AS event_type "
          f"FROM range({len(COVER_DATES) * len(COVER_TYPES)}) t(i)), "
          f"c AS (SELECT {D} AS event_date, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2) "
          "SELECT req.leaf_index, req.event_date, req.event_type, "
          "CASE WHEN c.n IS NULL THEN 'missing' ELSE 'found' END AS status, "
          "CAST(COALESCE(c.n, 0) AS BIGINT) AS rows "
          "FROM req LEFT JOIN c ON c.event_date = req.event_date AND c.event_type = req.event_type")
def partition_coverage(spark: SparkSession, sf: str):
    ds = events_ds(spark, sf, dates=COVER_DATES, types=COVER_TYPES)
    res = run(spark, {"datasets": [ds], "query": "SELECT 1 AS one"})
    return res.coverage().select("leaf_index", "event_date", "event_type", "status", "rows")


# --------------------------------------------------------------- joins
@register("join_range", BANDS_DUCK)
def join_range(spark: SparkSession, sf: str):
    # the same bands as in sql_range_bins, by the operator
    res = run(spark, {"datasets": [flat(sf, "customer"), flat(sf, "supplier")],
                      "query": "SELECT c_custkey, c_acctbal FROM customer"})
    suppliers = res.sql("SELECT COUNT(*) FROM supplier").first()[0]
    bands = res.sql("SELECT s_suppkey, s_acctbal AS lo, s_acctbal + CAST(33000 AS DOUBLE) / :n AS hi FROM supplier",
                    args={"n": suppliers})
    return range_join(res.df, bands, "c_acctbal", "lo", "hi").groupBy("s_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("least"), F.max("c_custkey").alias("last_key"))


# -------------------------------------------------------- registration
# Events are pre-aggregated per (user, type) before the join: the shuffle
# carries one row per pair instead of one per event, and a hot user is
# already collapsed by the map-side partial aggregate.
@register("register_join",
          f"WITH {DUCK_EV}, per AS (SELECT user_id, event_type, COUNT(*) AS n FROM ev GROUP BY 1, 2) "
          "SELECT c.c_mktsegment, p.event_type, CAST(SUM(p.n) AS BIGINT) AS n "
          "FROM per p JOIN customer c ON p.user_id = c.c_custkey GROUP BY 1, 2")
def register_join(spark: SparkSession, sf: str):
    return run_sql(spark, [events_ds(spark, sf), flat(sf, "customer")],
                   "WITH per AS (SELECT user_id, event_type, COUNT(*) AS n FROM ev GROUP BY 1, 2) "
                   "SELECT c.c_mktsegment, p.event_type, CAST(SUM(p.n) AS BIGINT) AS n "
                   "FROM per p JOIN customer c ON p.user_id = c.c_custkey GROUP BY 1, 2")


# ---------------------------------------------------------- parameters
PARAMS = {"FROM_DAY": "2024-01-05", "TO_DAY": "2024-01-25", "MIN_VALUE": 10}
_PARAM_ORACLE = (
    f"WITH {DUCK_EV} SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users "
    "FROM ev WHERE event_date >= '2024-01-05' AND event_date <= '2024-01-25' "
    "AND value >= 10 GROUP BY event_type")


@register("param_text", _PARAM_ORACLE)
def param_text(spark: SparkSession, sf: str):
    return run_sql(spark, [events_ds(spark, sf)],
                   "SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM ev "
                   "WHERE event_date >= '${FROM_DAY}' AND event_date <= '${TO_DAY}' "
                   "AND value >= ${MIN_VALUE} GROUP BY event_type", parameters=PARAMS)


@register("param_typed", _PARAM_ORACLE)
def param_typed(spark: SparkSession, sf: str):
    return run_sql(spark, [events_ds(spark, sf)],
                   "SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM ev "
                   "WHERE event_date BETWEEN :start AND :end AND value >= :min_value "
                   "GROUP BY event_type",
                   args={"start": "2024-01-05", "end": "2024-01-25", "min_value": 10})


@register("param_identifier",
          "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")
def param_identifier(spark: SparkSession, sf: str):
    return run_sql(spark, [flat(sf, "lineitem")],
                   "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM IDENTIFIER(:tbl) "
                   "GROUP BY l_returnflag, l_linestatus", args={"tbl": "lineitem"})


# ---------------------------------------------------------- view chain
SPEND_SQL = """CREATE TEMPORARY VIEW spend_by_kind AS
SELECT event_type, event_date, SUM(value) AS spent, COUNT(*) AS n, MAX(value) AS most
FROM ev
WHERE event_date >= '${FROM_DAY}'
GROUP BY event_type, event_date
"""

WEEKS_SQL = """CREATE TEMPORARY VIEW weeks AS
SELECT event_type, CAST(weekofyear(to_date(event_date)) AS INT) AS week,
       SUM(n) AS n, MAX(most) AS most
FROM spend_by_kind
GROUP BY 1, 2
"""

_SPEND_DUCK = (
    f"spend_by_kind AS (SELECT event_type, {D} AS event_date, ROUND(SUM(value), 4) AS spent, COUNT(*) AS n, "
    f"MAX(value) AS most FROM events WHERE {D} >= '2024-01-03' GROUP BY 1, 2)")


def _view_files(spark: SparkSession, sf: str, *named: tuple[str, str]) -> list[str]:
    return [fx.sql_file(spark, sf, name, text) for name, text in named]


@register("readme_daily_metrics", f"WITH {_SPEND_DUCK} SELECT * FROM spend_by_kind")
def readme_daily_metrics(spark: SparkSession, sf: str):
    views = _view_files(spark, sf, ("spend_by_kind", SPEND_SQL))
    return run_sql(spark, [events_ds(spark, sf)],
                   "SELECT event_type, event_date, ROUND(spent, 4) AS spent, n, most FROM spend_by_kind",
                   views=views, parameters={"FROM_DAY": "2024-01-03"})


@register("view_chain",
          f"WITH {_SPEND_DUCK} SELECT event_type, CAST(weekofyear(CAST(event_date AS DATE)) AS INTEGER) AS week, "
          "CAST(SUM(n) AS BIGINT) AS n, MAX(most) AS most FROM spend_by_kind GROUP BY 1, 2")
def view_chain(spark: SparkSession, sf: str):
    views = _view_files(spark, sf, ("spend_by_kind", SPEND_SQL), ("weeks", WEEKS_SQL), ("empty", "   \n"))
    return run_sql(spark, [events_ds(spark, sf)], "SELECT * FROM weeks",
                   views=views, parameters={"FROM_DAY": "2024-01-03"})


BAND_FUNCTION_SQL = """CREATE TEMPORARY FUNCTION value_band(v DOUBLE)
RETURNS STRING
RETURN CASE WHEN v < 10 THEN 'low' WHEN v < 50 THEN 'mid' ELSE 'high' END
"""


@register("view_chain_function",
          f"WITH {DUCK_EV} SELECT event_type, CASE WHEN value < 10 THEN 'low' "
          "WHEN value < 50 THEN 'mid' ELSE 'high' END AS band, COUNT(*) AS n "
          "FROM ev GROUP BY 1, 2")
def view_chain_function(spark: SparkSession, sf: str):
    views = [{"name": "band_function", "sql": BAND_FUNCTION_SQL},
             {"name": "banded", "sql": "CREATE TEMPORARY VIEW banded AS "
              "SELECT event_type, value_band(value) AS band FROM ev"}]
    return run_sql(spark, [events_ds(spark, sf)],
                   "SELECT event_type, band, COUNT(*) AS n FROM banded GROUP BY 1, 2",
                   views=views)


BIG_ORDERS_FUNCTION_SQL = """CREATE TEMPORARY FUNCTION big_orders(min_price DOUBLE)
RETURNS TABLE (o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING, o_totalprice DOUBLE)
RETURN SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice
       FROM orders WHERE o_totalprice > min_price
"""


@register("view_chain_table_function",
          "SELECT o_orderpriority, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers "
          "FROM orders WHERE o_totalprice > 300000 GROUP BY o_orderpriority")
def view_chain_table_function(spark: SparkSession, sf: str):
    return run_sql(spark, [flat(sf, "orders")],
                   "SELECT o_orderpriority, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers "
                   "FROM big_orders(${MIN_PRICE}) GROUP BY o_orderpriority",
                   views=[{"name": "big_orders", "sql": BIG_ORDERS_FUNCTION_SQL}],
                   parameters={"MIN_PRICE": 300000})


# ------------------------------------------------------------- README
TOP_USERS_SQL = """
WITH counted AS (
  SELECT user_id, COUNT(*) AS n_events
  FROM events
  WHERE event_date >= '${FROM_DAY}' AND event_date <= '${TO_DAY}'
  GROUP BY user_id
)
SELECT p.user_id, u.c_name AS person, p.n_events
FROM counted p
JOIN people u ON p.user_id = u.c_custkey
ORDER BY p.n_events DESC, p.user_id
LIMIT ${TOP}
"""
TOP_USERS_PARAMS = {"FROM_DAY": "2024-01-05", "TO_DAY": "2024-01-25", "TOP": 100}


def top_users_spec(spark: SparkSession, sf: str) -> dict:
    return {"datasets": [events_ds(spark, sf, name="events"), flat(sf, "customer", "people")],
            "query": TOP_USERS_SQL, "parameters": TOP_USERS_PARAMS}


@register("readme_top_users",
          f"WITH counted AS (SELECT user_id, COUNT(*) AS n_events FROM events "
          f"WHERE {D} >= '2024-01-05' AND {D} <= '2024-01-25' GROUP BY user_id) "
          "SELECT p.user_id, u.c_name AS person, p.n_events FROM counted p "
          "JOIN customer u ON p.user_id = u.c_custkey "
          "ORDER BY p.n_events DESC, p.user_id LIMIT 100")
def readme_top_users(spark: SparkSession, sf: str):
    return run(spark, top_users_spec(spark, sf)).df


@register("readme_filter_params",
          "SELECT * FROM part WHERE p_retailprice >= 950 AND p_type = 'ECONOMY'")
def readme_filter_params(spark: SparkSession, sf: str):
    return run_sql(spark, [flat(sf, "part", "shelf")],
                   "SELECT * FROM shelf WHERE p_retailprice >= ${LOWEST_PRICE} "
                   "AND p_type = '${KIND}'",
                   parameters={"LOWEST_PRICE": 950, "KIND": "ECONOMY"})


@register("query_override", "SELECT COUNT(*) AS n FROM events")
def query_override(spark: SparkSession, sf: str):
    return run(spark, top_users_spec(spark, sf), query="SELECT COUNT(*) AS n FROM events").df


# ---------------------------------------------------------------- sink
_RESULT_ORACLE = (f"WITH {DUCK_EV} SELECT event_date, event_type, COUNT(*) AS n, "
                  "COUNT(DISTINCT user_id) AS users FROM ev GROUP BY 1, 2")
_RESULT_SQL = ("SELECT event_date, event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users "
               "FROM ev GROUP BY 1, 2 ORDER BY 1, 2")


def _written(spark: SparkSession, sf: str, sql: str, datasets: list[dict] | None = None,
             conf: dict[str, str] | None = None) -> str:
    res = run(spark, {"datasets": datasets or [events_ds(spark, sf)], "query": sql, "sparkSessionConfig": conf or {}})
    return write_result(res.df, fx.results_dir(spark, sf), f"run-{uuid.uuid4()}")


@register("write_readback", _RESULT_ORACLE)
def write_readback(spark: SparkSession, sf: str):
    return read_result(spark, _written(spark, sf, _RESULT_SQL))


@register("result_preview",
          f"WITH {DUCK_EV} SELECT event_type, COUNT(*) AS n FROM ev GROUP BY 1")
def result_preview(spark: SparkSession, sf: str):
    path = _written(spark, sf, "SELECT event_type, COUNT(*) AS n FROM ev GROUP BY 1")
    return preview(spark, path, n=20)


# Ranges of a sort differ in size, and a task's files hold at most so many rows.
_UNEVEN_FILES = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxRecordsPerFile": "700"}
_PRICED_SQL = "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"
_PRICED_ORACLE = ("SELECT o_orderkey, o_orderdate, o_totalprice, "
                  "row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")


def _priced(spark: SparkSession, sf: str) -> str:
    return _written(spark, sf, _PRICED_SQL, [flat(sf, "orders")], _UNEVEN_FILES)


@register("result_preview_sorted", f"{_PRICED_ORACLE} ORDER BY place LIMIT 1000")
def result_preview_sorted(spark: SparkSession, sf: str):
    # the first rows of the result's order, though its files are of unequal size
    return preview(spark, _priced(spark, sf), n=1000, rank="place")


@register("result_read_ranked", _PRICED_ORACLE)
def result_read_ranked(spark: SparkSession, sf: str):
    # the whole result, each row with its place in the written order
    return read_ranked(spark, _priced(spark, sf), rank="place")


_TYPES_SQL = ("SELECT event_id, parse_json(props) AS doc, ts - TIMESTAMP_NTZ'2024-01-01 00:00:00' AS since, "
              "make_ym_interval(CAST(event_id % 5 AS INT), CAST(event_id % 12 AS INT)) AS span FROM events")


@register("write_types",
          "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, "
          "'{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS doc, "
          "CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) AS since_us, "
          "CAST(event_id % 5 AS VARCHAR) || '-' || CAST(event_id % 12 AS VARCHAR) AS span FROM events")
def write_types(spark: SparkSession, sf: str):
    """Variant and interval columns, written and read back."""
    path = _written(spark, sf, _TYPES_SQL, [flat(sf, "events")])
    back = read_result(spark, path)
    part = lambda unit, us: F.expr(f"CAST(extract({unit} FROM since) AS DECIMAL(20, 6)) * {us}")
    since = (part("DAY", 86_400_000_000) + part("HOUR", 3_600_000_000) + part("MINUTE", 60_000_000)
             + part("SECOND", 1_000_000))
    return back.select("event_id", F.variant_get("doc", "$.k", "bigint").alias("k"), F.to_json("doc").alias("doc"),
                       since.cast("bigint").alias("since_us"),
                       F.regexp_extract(F.col("span").cast("string"), "'([0-9-]+)'", 1).alias("span"))


@register("result_manifest", "SELECT TRUE AS has_files, TRUE AS has_bytes")
def result_manifest(spark: SparkSession, sf: str):
    path = _written(spark, sf, _RESULT_SQL)
    return manifest_summary(spark, path).select(
        (F.col("files") >= 1).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


@register("run_session_conf",
          "SELECT 'Asia/Tokyo' AS zone, CAST(floor((epoch(ts) - 32400) / 86400) AS BIGINT) AS utc_day, COUNT(*) AS n "
          "FROM events GROUP BY 2")
def run_session_conf(spark: SparkSession, sf: str):
    """A run takes on the runtime confs of the caller's session: local times
    are in its time zone."""
    caller = spark.newSession()
    caller.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    return run_sql(caller, [flat(sf, "events")],
                   "SELECT current_timezone() AS zone, CAST(floor(unix_seconds(CAST(ts AS TIMESTAMP)) / 86400) AS BIGINT) "
                   "AS utc_day, COUNT(*) AS n FROM events GROUP BY 1, 2")


@register("run_spec_json",
          "SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_acctbal > 1000 GROUP BY c_mktsegment")
def run_spec_json(spark: SparkSession, sf: str):
    """A run from a JSON document in the shared folder."""
    spec = {"datasets": [{"name": "customer", "path": f"{sf}/customer.parquet"}],
            "views": [{"name": "rich", "sql": "CREATE TEMPORARY VIEW rich AS SELECT * FROM customer "
                       "WHERE c_acctbal > ${LEAST}"}],
            "parameters": {"LEAST": 1000}, "outputPrefix": fx.results_dir(spark, sf),
            "query": "SELECT c_mktsegment, COUNT(*) AS n FROM rich GROUP BY c_mktsegment"}
    path = fx.sql_file(spark, sf, "run_spec", json.dumps(spec))
    return run(spark, RunSpec.load(spark, path, require_output=True)).df
