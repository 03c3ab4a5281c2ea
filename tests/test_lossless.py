"""The leaf union loses nothing: types, depth, damaged files, column order,
and driver work that grows in proportion to the spec."""

import os
import time

import pandas as pd
import pytest

from sqlrun import RunSpec, ScanError, SpecError, run, scan_dataset
from sqlrun.sources import footers
from sqlrun.sources.hive_paths import brace_glob, leaf_globs
from sqlrun.sources.result_sink import SinkError, output_path
from sqlrun.sources.text_files import read_whole_text

from .test_scan import _ds, naive_union, same_bag


def _write(spark, ddl, rows, path):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("one,other", [
    (("v bigint", 1), ("v double", 2.5)), (("v int", 1), ("v string", "7")), (("v int", 1), ("v bigint", 2**40)),
    (("v int", 1), ("v double", 0.5)), (("v float", 1.5), ("v decimal(10,2)", None)), (("v date", None), ("v timestamp", None)),
])
def test_types_widen_as_a_union_does(spark, scratch, one, other):
    base = f"{scratch}/t"
    _write(spark, one[0], [(one[1],)], f"{base}/p=1")
    _write(spark, other[0], [(other[1],)], f"{base}/p=2")
    for values in ([1, 2], [2, 1]):
        parts = [{"key": "p", "values": values}]
        ours, want = scan_dataset(spark, _ds(base, parts)).df, naive_union(spark, base, parts)
        assert ours.dtypes == want.dtypes
        assert same_bag(want, ours)


def test_leaves_of_different_depth(spark, scratch):
    base = f"{scratch}/t"
    _write(spark, "id int", [(1,)], f"{base}/d=1")
    _write(spark, "id int", [(2,)], f"{base}/d=2/hour=3")
    parts = [{"key": "d", "values": [1, 2]}]
    for kw in ({}, {"schema": "id INT"}, {"schema_mode": "first"}):
        df = scan_dataset(spark, _ds(base, parts, **kw)).df
        assert df.columns == ["id", "d", "hour"]
        assert sorted(map(tuple, df.collect()), key=str) == [(1, 1, None), (2, 2, 3)]


def _spoil(path):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("not parquet at all")


def test_a_damaged_file_beside_good_ones_is_named(spark, scratch):
    base = f"{scratch}/t"
    _write(spark, "id int", [(k,) for k in range(10)], f"{base}/p=a")
    for _ in range(3):
        _write(spark, "id int", [(k,) for k in range(100)], f"{base}/p=b")
    _spoil(f"{base}/p=b/part-bad.parquet")
    with pytest.raises(ScanError, match="part-bad.parquet"):
        scan_dataset(spark, _ds(base, [{"key": "p", "values": ["a", "b"]}]))


def test_a_leaf_without_a_readable_file_is_left_out(spark, scratch):
    base = f"{scratch}/t"
    _write(spark, "id int", [(1,)], f"{base}/p=a")
    _spoil(f"{base}/p=b/x.parquet")
    scan = scan_dataset(spark, _ds(base, [{"key": "p", "values": ["a", "b", "c"]}]))
    assert [r.id for r in scan.df.collect()] == [1]
    assert {r.p: r.status for r in scan.coverage().collect()} == {"a": "found", "b": "unreadable", "c": "missing"}


def test_two_schemas_within_one_leaf(spark, scratch):
    base = f"{scratch}/t"
    _write(spark, "v int", [(1,)], f"{base}/p=a")
    _write(spark, "v bigint, w int", [(2**40, 5)], f"{base}/p=a")
    _write(spark, "v bigint", [(3,)], f"{base}/p=b")
    df = scan_dataset(spark, _ds(base, [{"key": "p", "values": ["a", "b"]}])).df
    assert sorted((r.v, r.w, r.p) for r in df.select("v", "w", "p").collect() if r.w is None) == [
        (1, None, "a"), (3, None, "b")]
    assert df.filter("w = 5").first().v == 2**40


def test_other_failures_end_the_survey():
    read = footers._footer_reader()
    with pytest.raises(OSError):
        list(read(iter([pd.DataFrame({"path": ["/no/such/file.parquet"]})])))


def test_many_unreadable_leaves(spark, scratch):
    base = f"{scratch}/t"
    _write(spark, "id int", [(1,)], f"{base}/p=0")
    for k in range(1, 1200):
        _spoil(f"{base}/p={k}/x.parquet")
    scan = scan_dataset(spark, _ds(base, [{"key": "p", "values": list(range(1200))}]))
    assert scan.df.count() == 1
    assert scan.coverage(with_rows=False).filter("status = 'unreadable'").count() == 1199


def test_column_order_does_not_depend_on_missing_values(spark, scratch):
    base = f"{scratch}/t"
    _write(spark, "z int, a int", [(1, 2)], f"{base}/d=x")
    _write(spark, "m int, a int", [(3, 4)], f"{base}/d=y")
    orders = set()
    for missing in (0, 10, 1000):
        values = [f"none{k:04d}" for k in range(missing)] + ["x", "y"]
        orders.add(tuple(scan_dataset(spark, _ds(base, [{"key": "d", "values": values}])).df.columns))
    assert orders == {("z", "a", "d", "m")}


def test_long_value_lists_are_planned_in_proportion():
    values = [f"v{k}" for k in range(100_000)]
    ds = _ds("/data/t", [{"key": "d", "values": values}, {"key": "e", "values": ["x", "y"]}])
    t0 = time.time()
    assert len(leaf_globs(ds)) == 100_000 and brace_glob(ds).count(",") == 100_000
    assert time.time() - t0 < 10  # quadratic work would take minutes


def test_missing_values_cost_one_listing(spark, scratch):
    base = f"{scratch}/t"
    for k in range(3):
        _write(spark, "id int", [(k,)], f"{base}/d={k}")

    def planned(values):
        t0 = time.time()
        assert scan_dataset(spark, _ds(base, [{"key": "d", "values": values}])).df.count() == 3
        return time.time() - t0
    planned([0, 1, 2])  # warm
    few = min(planned([0, 1, 2]) for _ in range(3))
    many = min(planned([0, 1, 2, *range(100, 500)]) for _ in range(3))
    assert many < 3 * few + 1


@pytest.mark.parametrize("run_id", [".", "..", " .. ", "", " ", "a/b"])
def test_run_ids_that_leave_the_prefix(run_id):
    with pytest.raises(SinkError):
        output_path("/tmp/results", run_id)


def test_invalid_conf_values_are_errors(spark):
    spec = {"datasets": [{"name": "n", "path": "/root/testdata/sf0.001/nation.parquet"}], "query": "SELECT 1 AS one"}
    with pytest.raises(SpecError, match="shuffle.partitions"):
        run(spark, {**spec, "sparkSessionConfig": {"spark.sql.shuffle.partitions": "abc"}})
    res = run(spark, {**spec, "sparkSessionConfig": {"spark.sql.warehouse.dir": "/x", "spark.executor.memory": "4g"}})
    assert "spark.sql.warehouse.dir" in res.skipped_confs


def test_view_files_of_any_name(spark, scratch):
    for name, text in (("empty.sql", ""), ("_u.sql", "SELECT 1"), (".v.sql", "SELECT é")):
        with open(f"{scratch}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
        assert read_whole_text(spark, f"{scratch}/{name}") == text
        assert read_whole_text(spark, f"file:{scratch}/{name}") == text
    from sqlrun.sources.text_files import _hadoop_text
    assert _hadoop_text(spark, f"file:{scratch}/_u.sql") == "SELECT 1"
    assert _hadoop_text(spark, f"file:{scratch}/empty.sql") == ""


def test_driver_spec_is_read_without_a_session(scratch):
    with open(f"{scratch}/run.json", "w") as f:
        f.write('{"datasets": [{"name": "a", "path": "/x"}], "query": "SELECT 1", "outputPrefix": "/o", '
                '"sparkSessionConfig": {"spark.sql.warehouse.dir": "/w"}}')
    assert RunSpec.load(None, f"{scratch}/run.json").session_config == {"spark.sql.warehouse.dir": "/w"}


def test_a_corrupt_flat_file_names_the_dataset(spark, scratch):
    _spoil(f"{scratch}/bad.parquet")
    with pytest.raises(ScanError, match="dataset 't'"):
        scan_dataset(spark, {"name": "t", "path": f"{scratch}/bad.parquet"})


def test_a_changed_table_gets_a_new_layout(spark, scratch):
    from sqlrun.catalog import fixtures as fx
    ddl = "event_id bigint, ts timestamp_ntz, user_id bigint, value double, props string, event_type string"
    path = f"{scratch}/events.parquet"
    import datetime as dt
    spark.createDataFrame([(1, dt.datetime(2024, 1, 31), 1, 1.0, "{}", "view")], ddl).write.parquet(path)
    first = fx.events_by_day_type(spark, scratch)
    assert first == fx.events_by_day_type(spark, scratch)
    assert fx.layout_values(spark, first, "event_date") == ["2024-01-31"]
    spark.createDataFrame([(2, dt.datetime(2024, 2, 1), 1, 1.0, "{}", "buy")], ddl).write.mode("append").parquet(path)
    second = fx.events_by_day_type(spark, scratch)
    assert second != first and fx.layout_values(spark, second, "event_type") == ["buy", "view"]


def test_outer_joins_shuffle_counts_and_no_text(spark):
    from sqlrun import catalog
    catalog.load_all()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("sql_range", "sql_left_join", "sql_right_join"):
            plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
            assert "partial_count" in plan._jdf.queryExecution().executedPlan().toString(), name
        plan = catalog.QUERIES["sql_text_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        exchanged = [x for x in plan.toString().splitlines() if "Project" in x and "length(text" in x]
        assert exchanged and "chars" in exchanged[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
