"""Derived layouts of the given tables, written by Spark for the catalogue.

The given tables are flat Parquet files; the partition-list scan needs Hive
layouts.  Each layout is derived from a whole table by one distributed write
and kept under the cluster's shared checkpoint folder (``spark.checkpoint.dir``),
keyed by the source folder and by the names, sizes and times of its table's
files, so every query and every bench run reuses it and a changed table gets a
layout of its own.  The partition values that a table holds are stored beside
its layout: the queries list what is there, not a fixed range.
Without that setting only a single-process local session works (see
``sources/shared_folder.py``).

Writes use the ``REBALANCE`` hint on the partition columns: AQE then splits a
hot partition value into several files instead of one straggler task, and
merges small ones, so a layout survives a value that holds a third of all rows.
"""

from __future__ import annotations

import hashlib
import os
import threading
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.hive_paths import HIVE_NULL
from ..sources.shared_folder import shared_dir

LAYOUT_VERSION = "v4"

def layout_root(spark: SparkSession, sf_dir: str) -> str:
    tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:10]
    name = os.path.basename(os.path.normpath(sf_dir)) or "data"
    return f"{shared_dir(spark)}/sqlrun-layouts-{LAYOUT_VERSION}/{name}-{tag}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Changes with the names, sizes and times of the table's files.  In one
    local process the driver sees the files itself; else a small job does."""
    path = f"{sf_dir}/{name}.parquet"
    if spark.sparkContext.master.startswith("local[") and os.path.exists(path):
        found = [path] if os.path.isfile(path) else [os.path.join(d, f) for d, _, own in os.walk(path) for f in own]
        stats = sorted((f, os.stat(f).st_size, os.stat(f).st_mtime_ns) for f in found)
        return hashlib.sha1(str(stats).encode()).hexdigest()[:10]
    files = (spark.read.format("binaryFile").load(f"{sf_dir}/{name}.parquet")
             .select("path", "length", "modificationTime"))
    row = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return hashlib.sha1(str(tuple(row)).encode()).hexdigest()[:10]


_LOCKS: dict[str, threading.Lock] = {}
_KNOWN_COMPLETE: set[str] = set()  # a path names its content, so complete once is complete
_LOCKS_GUARD = threading.Lock()

# Hidden (underscore) folders, which partition discovery skips: the distinct
# partition values, and a mark written last, so that a layout is complete.
_VALUES, _COMPLETE = "_values", "_complete"


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).schema  # listing only, no job
        return True
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return False
        raise


def _ensure(spark: SparkSession, path: str, build: Callable[[str], None]) -> str:
    with _LOCKS_GUARD:
        lock = _LOCKS.setdefault(path, threading.Lock())
    with lock:
        if path not in _KNOWN_COMPLETE and not _exists(spark, f"{path}/{_COMPLETE}"):
            build(path)
            spark.range(0).write.mode("overwrite").parquet(f"{path}/{_COMPLETE}")
        _KNOWN_COMPLETE.add(path)
    return path


def _layout(spark: SparkSession, sf_dir: str, source: str, name: str,
            build: Callable[[DataFrame, str], None]) -> str:
    path = f"{layout_root(spark, sf_dir)}/{name}-{fingerprint(spark, sf_dir, source)}"
    return _ensure(spark, path, lambda p: build(table(spark, sf_dir, source), p))


def _partitioned(df: DataFrame, path: str, *cols: str) -> None:
    write_partitioned(df, path, *cols)
    df.select(*cols).distinct().write.mode("overwrite").parquet(f"{path}/{_VALUES}")


_KNOWN_VALUES: dict[tuple[str, str], list] = {}


def layout_values(spark: SparkSession, path: str, col: str) -> list:
    """The values of a partition column that a layout holds, sorted; as many
    as the column has folders.  A layout's path changes with its table, so
    what was read once still holds."""
    if (path, col) not in _KNOWN_VALUES:
        rows = spark.read.parquet(f"{path}/{_VALUES}").select(col).distinct().orderBy(col).collect()
        _KNOWN_VALUES[path, col] = [r[0] for r in rows]
    return list(_KNOWN_VALUES[path, col])


def write_partitioned(df: DataFrame, path: str, *cols: str, mode: str = "overwrite") -> None:
    """Hive-partitioned Parquet write that survives a hot partition value:
    ``REBALANCE`` on the partition columns lets AQE split an oversized
    partition into several files and merge small ones."""
    df.hint("rebalance", *cols).write.mode(mode).partitionBy(*cols).parquet(path)


def _days(ev: DataFrame) -> DataFrame:
    return ev.withColumn("event_date", F.to_date("ts").cast("string"))


def events_by_day_type(spark: SparkSession, sf_dir: str) -> str:
    """`events` partitioned by event_date (string) and event_type."""
    return _layout(spark, sf_dir, "events", "events_by_day_type",
                   lambda ev, p: _partitioned(_days(ev), p, "event_date", "event_type"))


def events_by_day_hour(spark: SparkSession, sf_dir: str) -> str:
    """`events` partitioned by event_date and hour (two levels)."""
    return _layout(spark, sf_dir, "events", "events_by_day_hour",
                   lambda ev, p: _partitioned(_days(ev).withColumn("hour", F.hour("ts")), p, "event_date", "hour"))


def events_by_day_hour_type(spark: SparkSession, sf_dir: str) -> str:
    """`events` under three levels: event_date / hour / event_type."""
    return _layout(spark, sf_dir, "events", "events_by_day_hour_type",
                   lambda ev, p: _partitioned(_days(ev).withColumn("hour", F.hour("ts")), p,
                                              "event_date", "hour", "event_type"))


# Fixed value: days by which a layout moves `events`, over the end of a month.
SHIFT_DAYS = 20


def events_shifted(spark: SparkSession, sf_dir: str) -> str:
    """`events` some days later, by event_date."""
    return _layout(spark, sf_dir, "events", "events_shifted",
                   lambda ev, p: _partitioned(_days(ev.withColumn("ts", F.expr(f"ts + INTERVAL '{SHIFT_DAYS}' DAY"))),
                                              p, "event_date"))


def orders_by_year(spark: SparkSession, sf_dir: str) -> str:
    return _layout(spark, sf_dir, "orders", "orders_by_year",
                   lambda o, p: _partitioned(o.withColumn("o_year", F.year("o_orderdate")), p, "o_year"))


def events_overlap(spark: SparkSession, sf_dir: str) -> str:
    """Directories ``event_type=<type>`` whose files *also* hold an
    ``event_type`` column, with a conflicting (upper-case) value.  A writer
    can't partition by a column that it also keeps, so each type is a write."""
    def build(ev: DataFrame, path: str) -> None:
        types = [r[0] for r in ev.select("event_type").distinct().collect()]
        for t in types:
            (ev.filter(F.col("event_type").eqNullSafe(t))
             .withColumn("event_type", F.upper("event_type"))
             .write.mode("overwrite").parquet(f"{path}/event_type={HIVE_NULL if t is None else t}"))
        ev.select("event_type").distinct().write.mode("overwrite").parquet(f"{path}/{_VALUES}")
    return _layout(spark, sf_dir, "events", "events_overlap", build)


# The event types written with the older file schema; all others
# have the newer one.
OLD_SCHEMA_TYPES = ["click", "error"]


def _two_schemas(spark: SparkSession, sf_dir: str, name: str, old: Callable[[DataFrame], DataFrame],
                 new: Callable[[DataFrame], DataFrame] = lambda ev: ev, old_levels: tuple[str, ...] = (),
                 new_levels: tuple[str, ...] = ()) -> str:
    """`events` by event_type with two kinds of leaves: one write for each."""
    def build(ev: DataFrame, path: str) -> None:
        is_old = F.coalesce(F.col("event_type").isin(OLD_SCHEMA_TYPES), F.lit(False))
        write_partitioned(old(ev.filter(is_old)), path, "event_type", *old_levels)
        write_partitioned(new(ev.filter(~is_old)), path, "event_type", *new_levels, mode="append")
        ev.select("event_type").distinct().write.mode("overwrite").parquet(f"{path}/{_VALUES}")
    return _layout(spark, sf_dir, "events", name, build)


def events_evolved(spark: SparkSession, sf_dir: str) -> str:
    """Two file schemas under one base: older leaves lack ``props`` and hold
    ``event_id`` as INT; newer leaves have the full schema (BIGINT)."""
    return _two_schemas(spark, sf_dir, "events_evolved",
                        lambda ev: ev.select(F.col("event_id").cast("int").alias("event_id"), "ts",
                                             "user_id", "value", "event_type"))


def events_bigint_double(spark: SparkSession, sf_dir: str) -> str:
    """``value`` is a BIGINT in the older leaves and a DOUBLE in the newer."""
    return _two_schemas(spark, sf_dir, "events_bigint_double",
                        lambda ev: ev.withColumn("value", F.floor("value").cast("bigint")))


def events_int_string(spark: SparkSession, sf_dir: str) -> str:
    """``user_id`` is an INT in the older leaves and text in the newer."""
    return _two_schemas(spark, sf_dir, "events_int_string",
                        lambda ev: ev.withColumn("user_id", F.col("user_id").cast("int")),
                        lambda ev: ev.withColumn("user_id", F.col("user_id").cast("string")))


def events_mixed_depth(spark: SparkSession, sf_dir: str) -> str:
    """Older leaves hold files, newer ones ``hour=<h>`` folders."""
    return _two_schemas(spark, sf_dir, "events_mixed_depth", lambda ev: ev,
                        lambda ev: ev.withColumn("hour", F.hour("ts")), new_levels=("hour",))


def event_calendar(spark: SparkSession, sf_dir: str) -> str:
    """The days of `events`, with their day of the week (1 is Sunday)."""
    return _layout(spark, sf_dir, "events", "event_calendar",
                   lambda ev, p: _days(ev).select("event_date").distinct()
                   .withColumn("weekday", F.dayofweek("event_date")).write.mode("overwrite").parquet(p))


# The sites among which a layout shares out `events`, and those
# whose files lack `props`.
SITES = ["north", "south", "west"]
SITES_WITHOUT_PROPS = ["west"]


def event_sites(spark: SparkSession, sf_dir: str) -> str:
    """`events` under a folder for each site, then by event_date: one base
    path of the kind ``sites/*``.  Each site's files are a write."""
    def build(ev: DataFrame, path: str) -> None:
        site = F.element_at(F.array(*map(F.lit, SITES)), (F.pmod("event_id", F.lit(len(SITES))) + 1).cast("int"))
        for name in SITES:
            own = _days(ev.filter(site == name))
            write_partitioned(own.drop("props") if name in SITES_WITHOUT_PROPS else own,
                              f"{path}/sites/{name}", "event_date")
        _days(ev).select("event_date").distinct().write.mode("overwrite").parquet(f"{path}/{_VALUES}")
    return _layout(spark, sf_dir, "events", "event_sites", build)


# Fixed value: the day of which a layout holds no readable file.
SPOILED_DATE = "2024-01-04"


def events_spoiled(spark: SparkSession, sf_dir: str) -> str:
    """`events` by event_date; one day's folder holds a file that is no Parquet."""
    def build(ev: DataFrame, path: str) -> None:
        _partitioned(_days(ev).filter(F.col("event_date") != SPOILED_DATE), path, "event_date")
        (spark.createDataFrame([("no parquet file at all",)], "value string").coalesce(1)
         .write.mode("overwrite").text(f"{path}/event_date={SPOILED_DATE}"))
    return _layout(spark, sf_dir, "events", "events_spoiled", build)


def part_csv(spark: SparkSession, sf_dir: str) -> str:
    """`part` as CSV with a header line."""
    return _layout(spark, sf_dir, "part", "part_csv",
                   lambda part, p: part.write.mode("overwrite").option("header", "true").csv(p))


def sql_file(spark: SparkSession, sf_dir: str, name: str, text: str) -> str:
    """A one-file SQL text (a view body), written through Spark so the view
    chain reads it the same way it reads any cluster path."""
    digest = hashlib.sha1(text.encode()).hexdigest()[:10]

    def build(path: str) -> None:
        (spark.createDataFrame([(text,)], "value string").coalesce(1)
         .write.mode("overwrite").text(path))
    return _ensure(spark, f"{layout_root(spark, sf_dir)}/sql/{name}-{digest}", build)


def results_dir(spark: SparkSession, sf_dir: str) -> str:
    return layout_root(spark, sf_dir) + "/results"
