"""One listing for all that is asked of a partition list: tolerance in every
schema mode, footers by leaf, many roots, pruning while a query runs."""

import os

import pytest

from sqlrun import ScanError, SpecError, run, scan_dataset
from sqlrun.catalog import fixtures as fx
from sqlrun.sources import file_index, footers

from .conftest import EVENT_DATES, EVENT_TYPES, SF_SMALL
from .test_lossless import _spoil, _write
from .test_scan import _ds, naive_union, same_bag

MODES = [{}, {"schema": "id INT"}, {"schema_mode": "first"}, {"schema_mode": "leaf"}]


def listing_jobs(spark):
    """Spark's jobs so far that list folders."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs = store.jobsList(spark._jvm.java.util.ArrayList())
    said = [jobs.apply(k).description() for k in range(jobs.size())]
    return sum(d.isDefined() and d.get().startswith("Listing leaf files") for d in said)


@pytest.mark.parametrize("mode", [{}, {"schema_mode": "leaf"}])
def test_leaves_are_listed_once_beside_the_scan(spark, monkeypatch, mode):
    base = fx.events_by_day_type(spark, SF_SMALL)
    parts = [{"key": "event_date", "values": EVENT_DATES}, {"key": "event_type", "values": [*EVENT_TYPES, "none"]}]
    listed = []
    lists = file_index.list_files
    monkeypatch.setattr(file_index, "list_files", lambda *a: listed.append(a) or lists(*a))
    before = listing_jobs(spark)
    scan = scan_dataset(spark, _ds(base, parts, **mode))
    assert scan.df.count() > 0
    cover = [scan.coverage().collect(), scan.coverage(with_rows=False).collect()]
    assert len(cover[0]) == len(cover[1]) == 180
    assert len(listed) == 1
    # the index, and the listing that Spark's reader does for the scan itself
    assert listing_jobs(spark) - before <= 2


def test_missing_values_are_listed_once_too(spark, monkeypatch):
    base = fx.events_by_day_type(spark, SF_SMALL)
    parts = [{"key": "event_date", "values": ["2099-01-01", *EVENT_DATES]}, {"key": "event_type", "values": EVENT_TYPES}]
    listed = []
    index = file_index.FileIndex._listed
    monkeypatch.setattr(file_index.FileIndex, "_listed", lambda self: listed.append(1) or index(self))
    scan = scan_dataset(spark, _ds(base, parts))
    assert scan.df.columns[-2:] == ["event_date", "event_type"]
    assert scan.coverage().filter("status = 'missing'").count() == len(EVENT_TYPES) and len(listed) == 1


@pytest.mark.parametrize("mode", MODES)
def test_unreadable_leaves_are_left_out_in_every_mode(spark, scratch, mode):
    base = f"{scratch}/t"
    for k, p in enumerate(("a", "c d", "e:f")):
        _write(spark, "id int", [(k,)], f"{base}/p={'e%3Af' if p == 'e:f' else p}")
    _spoil(f"{base}/p=b/x.parquet")
    with open(f"{base}/p=b/y.parquet", "wb") as f:  # ends like Parquet, but its footer doesn't fit
        f.write(b"PAR1" + b"\x00" * 20 + (10 ** 6).to_bytes(4, "little") + b"PAR1")
    scan = scan_dataset(spark, _ds(base, [{"key": "p", "values": ["b", "a", "c d", "e:f", "none"]}], **mode))
    assert sorted(map(tuple, scan.df.collect())) == [(0, "a"), (1, "c d"), (2, "e:f")]
    assert {r.p: (r.status, r.rows) for r in scan.coverage().collect()} == {
        "a": ("found", 1), "b": ("unreadable", None), "c d": ("found", 1), "e:f": ("found", 1), "none": ("missing", 0)}


@pytest.mark.parametrize("mode", MODES)
def test_a_damaged_file_beside_a_whole_one_is_named_in_every_mode(spark, scratch, mode):
    base = f"{scratch}/t"
    _write(spark, "id int", [(1,)], f"{base}/p=a")
    _write(spark, "id int", [(2,)], f"{base}/p=b")
    _spoil(f"{base}/p=b/part-zz.parquet")
    with pytest.raises(ScanError, match="part-zz.parquet"):
        scan_dataset(spark, _ds(base, [{"key": "p", "values": ["a", "b"]}], **mode))


@pytest.mark.parametrize("mode", MODES)
def test_nothing_readable_is_an_error_in_every_mode(spark, scratch, mode):
    for p in "ab":
        _spoil(f"{scratch}/t/p={p}/x.parquet")
    with pytest.raises(ScanError, match="No data loaded"):
        scan_dataset(spark, _ds(f"{scratch}/t", [{"key": "p", "values": ["a", "b"]}], **mode))


def test_files_go_unchecked_on_demand(spark, scratch):
    base = f"{scratch}/t"
    _write(spark, "id int", [(1,)], f"{base}/p=a")
    _spoil(f"{base}/p=b/x.parquet")
    parts = [{"key": "p", "values": ["a", "b"]}]
    unchecked = scan_dataset(spark, _ds(base, parts, schema="id INT", check_files=False))
    with pytest.raises(Exception):
        unchecked.df.collect()
    # a leaf's own sample is read anyway
    assert scan_dataset(spark, _ds(base, parts, schema_mode="leaf", check_files=False)).df.count() == 1
    with pytest.raises(SpecError, match="check_files"):
        _ds(base, parts, check_files="no")
    with pytest.raises(SpecError, match="partition list"):
        _ds(base, [], schema_mode="leaf")


def test_leaf_mode_reads_one_file_of_each_leaf(spark, scratch):
    """The documented difference to a merge of all files: a column that only a
    leaf's second file holds isn't seen."""
    base = f"{scratch}/t"
    spark.createDataFrame([(1,)], "id int").coalesce(1).write.parquet(f"{base}/p=a")
    first = next(f for f in os.listdir(f"{base}/p=a") if f.endswith(".parquet"))
    os.rename(f"{base}/p=a/{first}", f"{base}/p=a/part-00000.parquet")
    spark.createDataFrame([(2, 3)], "id int, late int").coalesce(1).write.parquet(f"{scratch}/more")
    second = next(f for f in os.listdir(f"{scratch}/more") if f.endswith(".parquet"))
    os.rename(f"{scratch}/more/{second}", f"{base}/p=a/part-00001.parquet")
    _write(spark, "id int, other int", [(4, 5)], f"{base}/p=b")
    parts = [{"key": "p", "values": ["a", "b"]}]
    leaf = scan_dataset(spark, _ds(base, parts, schema_mode="leaf")).df
    merged = scan_dataset(spark, _ds(base, parts)).df
    assert leaf.columns == ["id", "p", "other"] and set(merged.columns) == {"id", "late", "p", "other"}
    assert leaf.count() == merged.count() == 3


@pytest.mark.parametrize("one,other,scans", [
    (("v int", 1), ("v bigint", 2 ** 40), 1), (("v int", 1), ("v double", 0.5), 1), (("v float", 1.5), ("v double", 2.5), 1),
    (("v tinyint", 1), ("v int", 7), 1), (("v bigint", 1), ("v double", 2.5), 2), (("v int", 1), ("v string", "7"), 2),
    (("s struct<p:int>", (1,)), ("s struct<q:int>", (2,)), 1), (("v int, a array<int>", (1, [2])), ("w int", 3), 1),
])
def test_leaf_mode_widens_as_a_union_does(spark, scratch, one, other, scans):
    base = f"{scratch}/t"
    for k, (ddl, v) in enumerate((one, other), 1):
        _write(spark, ddl, [v if "," in ddl.split("<")[0] and isinstance(v, tuple) else (v,)], f"{base}/p={k}")
    for values in ([1, 2], [2, 1]):
        parts = [{"key": "p", "values": values}]
        ours, want = scan_dataset(spark, _ds(base, parts, schema_mode="leaf")).df, naive_union(spark, base, parts)
        assert ours.dtypes == want.dtypes
        assert sorted(map(str, ours.collect())) == sorted(map(str, want.collect()))
        assert ours._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == scans


def test_leaf_mode_over_many_leaves_equals_the_merge(spark):
    base = fx.events_by_day_hour(spark, SF_SMALL)
    parts = [{"key": "event_date", "values": EVENT_DATES[:9]}, {"key": "hour", "values": list(range(24))}]
    leaf, merged = (scan_dataset(spark, _ds(base, parts, **kw)).df for kw in ({"schema_mode": "leaf"}, {}))
    assert leaf.dtypes == merged.dtypes and same_bag(leaf, merged)


def test_leaves_of_different_depth_by_footers_of_leaves(spark, scratch):
    base = f"{scratch}/t"
    _write(spark, "id int", [(1,)], f"{base}/d=1")
    _write(spark, "id int", [(2,)], f"{base}/d=2/hour=3")
    df = scan_dataset(spark, _ds(base, [{"key": "d", "values": [1, 2]}], schema_mode="leaf")).df
    assert df.columns == ["id", "d", "hour"]
    assert sorted(map(tuple, df.collect()), key=str) == [(1, 1, None), (2, 2, 3)]


# ------------------------------------------------------------------ many roots
def _sites(spark, scratch):
    _write(spark, "id int, a string", [(1, "x")], f"{scratch}/eu/t/d=1")
    _write(spark, "id int, a string", [(2, "y")], f"{scratch}/eu/t/d=2")
    _write(spark, "id bigint, b int", [(3, 7)], f"{scratch}/us/t/d=2")
    _write(spark, "id bigint, b int", [(4, 8)], f"{scratch}/us/t/d=9")
    os.makedirs(f"{scratch}/asia/t")
    return f"{scratch}/*/t"


@pytest.mark.parametrize("mode", [{}, {"schema_mode": "leaf"}, {"schema_mode": "first"}])
def test_a_glob_base_stands_for_its_roots(spark, scratch, mode):
    base = _sites(spark, scratch)
    scan = scan_dataset(spark, _ds(base, [{"key": "d", "values": [2, 1, 2, 3]}], **mode))
    assert scan.df.columns == ["id", "a", "d", "b"] and dict(scan.df.dtypes)["id"] == "bigint"
    assert sorted((r.id, r.a, r.d, r.b) for r in scan.df.collect()) == [
        (1, "x", 1, None), (2, "y", 2, None), (2, "y", 2, None), (3, None, 2, 7), (3, None, 2, 7)]
    cover = {r.d: (r.status, r.files >= 1, r.rows) for r in scan.coverage().collect()}
    assert cover == {"1": ("found", True, 1), "2": ("found", True, 2), "3": ("missing", False, 0)}
    with pytest.raises(ScanError, match="No data loaded"):
        scan_dataset(spark, _ds(base, [{"key": "d", "values": [77]}], **mode))


def test_a_glob_base_with_a_declared_schema(spark, scratch):
    base = _sites(spark, scratch)
    scan = scan_dataset(spark, _ds(f"{scratch}/{{eu,us}}/t", [{"key": "d", "values": [1, 2]}], schema="id BIGINT, b INT"))
    assert scan.df.columns == ["id", "b", "d"] and scan.df.count() == 3
    assert scan_dataset(spark, _ds(base, [{"key": "d", "values": [9]}])).df.first().id == 4


def test_unreadable_leaves_below_some_roots(spark, scratch):
    base = _sites(spark, scratch)
    _spoil(f"{scratch}/asia/t/d=5/x.parquet")
    scan = scan_dataset(spark, _ds(base, [{"key": "d", "values": [1, 5]}]))
    assert scan.df.count() == 1
    assert {r.d: r.status for r in scan.coverage().collect()} == {"1": "found", "5": "unreadable"}
    _spoil(f"{scratch}/asia/t/d=2/x.parquet")  # whole below two other roots
    with pytest.raises(ScanError, match="asia"):
        scan_dataset(spark, _ds(base, [{"key": "d", "values": [1, 2]}]))


# --------------------------------------------------------------------- reading
def test_tails_of_files(tmp_path):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    whole = tmp_path / "whole # 1%.parquet"
    pq.write_table(pa.table({"x": [1]}), whole)
    data = whole.read_bytes()
    for name, body in (("short", b"PAR1"), ("cut", data[:-3]), ("text", b"x" * 500), ("thrift", data[:8] + b"\xff" * (len(data) - 16) + data[-8:])):
        (tmp_path / name).write_bytes(body)

    def kinds(parse):
        files = [f"file:{tmp_path}/{n}" for n in (whole.name, "short", "cut", "text", "thrift")]
        return list(next(footers._footer_reader(parse)(iter([pd.DataFrame({"path": files})])))["kind"])
    assert kinds(False) == [footers.WHOLE, None, None, None, footers.WHOLE]
    assert [k is None for k in kinds(True)] == [False, True, True, True, True]
    # a store that Arrow can't open is left to Spark
    for parse in (False, True):
        other = next(footers._footer_reader(parse, True)(iter([pd.DataFrame({"path": ["viewfs://store/x"]})])))
        assert list(other["kind"]) == [footers.UNSEEN]


def test_dynamic_pruning_reads_fewer_files(spark):
    base, calendar = fx.events_by_day_type(spark, SF_SMALL), fx.event_calendar(spark, SF_SMALL)
    spec = {"datasets": [{"name": "ev", "path": base, "partitions": [
        {"key": "event_date", "values": EVENT_DATES}, {"key": "event_type", "values": EVENT_TYPES}]},
        {"name": "calendar", "path": calendar}],
        "query": "SELECT e.event_id FROM ev e JOIN calendar c ON e.event_date = c.event_date WHERE c.weekday = 1"}
    df = run(spark, spec).df
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()
    df.collect()

    def files(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return files(plan.executedPlan())
        own = plan.metrics().get("numFiles")
        own = [own.get().value()] if own.isDefined() and "event_type" in plan.toString() else []
        inner = [plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else []
        children = plan.children()
        return own + [n for p in [*inner, *(children.apply(k) for k in range(children.size()))] for n in files(p)]
    read = max(files(df._jdf.queryExecution().executedPlan()))
    days = spark.read.parquet(calendar).filter("weekday = 1").count()
    assert 0 < read <= days * len(EVENT_TYPES) < len(EVENT_DATES) * len(EVENT_TYPES)
