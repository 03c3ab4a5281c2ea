"""Partition-list scan: parity with a naive leaf-by-leaf union, typing,
escaping, NULL partitions, evolution, holes, errors and plan shape."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlrun import DatasetSpec, PartitionKey, RunSpec, ScanError, SpecError, run, scan_dataset
from sqlrun.catalog import fixtures as fx

from .conftest import EVENT_DATES, EVENT_TYPES, SF_SMALL


def _ds(path, parts, name="t", **kw):
    return RunSpec.from_dict({"datasets": [{"name": name, "path": path, "partitions": parts, **kw}],
                              "query": "SELECT 1"}).datasets[0]


def naive_union(spark, base, parts):
    """The per-leaf way: read each leaf, add the values as literals, fold a
    by-name union; missing leaves skipped."""
    import itertools

    keys = [p["key"] for p in parts]
    frames = []
    for combo in itertools.product(*[p["values"] for p in parts]):
        path = base + "/" + "/".join(f"{k}={v}" for k, v in zip(keys, combo))
        if not os.path.isdir(path):
            continue
        df = spark.read.parquet(path)
        for k, v in zip(keys, combo):
            df = df.withColumn(k, F.lit(v))
        frames.append(df)
    acc = frames[0]
    for f in frames[1:]:
        acc = acc.unionByName(f, allowMissingColumns=True)
    return acc


def same_bag(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def events_base(spark):
    return fx.events_by_day_type(spark, SF_SMALL)


@pytest.mark.parametrize("dates,types", [
    (["2024-01-01", "2024-01-02"], ["click", "view"]),
    (["2024-01-03", "2099-01-01", "2024-01-03"], ["error"]),
    (EVENT_DATES[:7], ["purchase", "signup", "nope", "purchase"]),
])
def test_parity_with_leaf_union(spark, events_base, dates, types):
    parts = [{"key": "event_date", "values": dates}, {"key": "event_type", "values": types}]
    ours = scan_dataset(spark, _ds(events_base, parts)).df
    assert same_bag(naive_union(spark, events_base, parts), ours)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(dates=st.lists(st.sampled_from(EVENT_DATES[:10] + ["2099-12-31"]), min_size=1, max_size=5),
       types=st.lists(st.sampled_from(EVENT_TYPES + ["none"]), min_size=1, max_size=4),
       swap=st.booleans())
def test_count_is_sum_of_multiplicity_times_leaf_rows(spark, events_base, dates, types, swap):
    flat = spark.read.parquet(f"{SF_SMALL}/events.parquet") \
        .withColumn("event_date", F.to_date("ts").cast("string"))
    per_leaf = {(r.event_date, r.event_type): r["count"]
                for r in flat.groupBy("event_date", "event_type").count().collect()}
    expected = sum(per_leaf.get((d, t), 0) for d in dates for t in types)
    if not any(per_leaf.get((d, t)) for d in dates for t in types):
        return  # nothing listed exists: covered by test_all_missing_is_an_error
    parts = [{"key": "event_date", "values": dates}, {"key": "event_type", "values": types}]
    ds = _ds(events_base, parts)
    assert scan_dataset(spark, ds).df.count() == expected
    if swap:  # order of values does not change the bag
        ds2 = _ds(events_base, [{"key": "event_date", "values": dates[::-1]},
                                {"key": "event_type", "values": types[::-1]}])
        assert same_bag(scan_dataset(spark, ds).df, scan_dataset(spark, ds2).df)


def test_plan_is_one_pruned_scan(spark, events_base):
    ds = _ds(events_base, [{"key": "event_date", "values": EVENT_DATES},
                           {"key": "event_type", "values": EVENT_TYPES}])
    df = scan_dataset(spark, ds).df.filter("event_date = '2024-01-02' AND value > 5").select("user_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "Union" not in plan
    assert "PartitionFilters: [isnotnull(event_date" in plan and "2024-01-02" in plan
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,5.0)]" in plan
    assert "ReadSchema: struct<user_id:bigint,value:double>" in plan


def test_string_partition_values_stay_text(spark, scratch):
    base = f"{scratch}/t"
    spark.createDataFrame([(1, "01"), (2, "08"), (3, "2024-01-01")], "id int, k string") \
        .write.partitionBy("k").parquet(base)
    ds = _ds(base, [{"key": "k", "values": ["01", "08", "2024-01-01"]}])
    df = scan_dataset(spark, ds).df
    assert dict(df.dtypes)["k"] == "string"
    assert sorted(r.k for r in df.collect()) == ["01", "08", "2024-01-01"]


def test_int_values_give_int_column_and_declared_type_wins(spark, scratch):
    base = f"{scratch}/t"
    spark.createDataFrame([(1, 7), (2, 8)], "id int, k int").write.partitionBy("k").parquet(base)
    assert dict(scan_dataset(spark, _ds(base, [{"key": "k", "values": [7, 8]}])).df.dtypes)["k"] == "int"
    big = _ds(base, [{"key": "k", "values": [7, 8, 2**40]}])
    assert dict(scan_dataset(spark, big).df.dtypes)["k"] == "bigint"
    declared = _ds(base, [{"key": "k", "values": [7], "type": "string"}])
    assert scan_dataset(spark, declared).df.collect()[0].k == "7"
    mixed = _ds(base, [{"key": "k", "values": [7, "8"]}])
    assert dict(scan_dataset(spark, mixed).df.dtypes)["k"] == "string"


def test_escaped_values_and_null_partition(spark, scratch):
    base = f"{scratch}/t"
    vals = ["a:b c/d", "x,y", "*", "q{r}", None, "plain"]
    spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, k string") \
        .write.partitionBy("k").parquet(base)
    got = scan_dataset(spark, _ds(base, [{"key": "k", "values": ["a:b c/d", "x,y", "*", "q{r}", None]}])).df
    assert sorted((r.k is None, r.k or "") for r in got.collect()) == \
        sorted((v is None, v or "") for v in vals if v != "plain")
    # "*" is a value, not a wildcard
    star = scan_dataset(spark, _ds(base, [{"key": "k", "values": ["*"]}])).df
    assert [r.k for r in star.collect()] == ["*"]


def test_boolean_partitions_match_both_spellings(spark, scratch):
    base = f"{scratch}/t"
    spark.createDataFrame([(1,)], "id int").write.parquet(f"{base}/flag=true")
    spark.createDataFrame([(2,)], "id int").write.parquet(f"{base}/flag=False")
    df = scan_dataset(spark, _ds(base, [{"key": "flag", "values": [True, False]}])).df
    assert dict(df.dtypes)["flag"] == "boolean"
    assert sorted((r.id, r.flag) for r in df.collect()) == [(1, True), (2, False)]


def test_schema_evolution_widens_and_orders_like_a_union(spark, scratch):
    base = f"{scratch}/t"
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{base}/p=1")
    spark.createDataFrame([(2, 3)], "a bigint, b int").write.parquet(f"{base}/p=2")
    df = scan_dataset(spark, _ds(base, [{"key": "p", "values": [1, 2]}])).df
    assert df.columns == ["a", "p", "b"]
    assert dict(df.dtypes) == {"a": "bigint", "p": "int", "b": "int"}
    assert sorted(tuple(r) for r in df.collect()) == [(1, 1, None), (2, 2, 3)]


def test_nested_struct_fields_merge(spark, scratch):
    base = f"{scratch}/t"
    spark.createDataFrame([((1,),)], "s struct<p:int>").write.parquet(f"{base}/x=1")
    spark.createDataFrame([((2,),)], "s struct<q:int>").write.parquet(f"{base}/x=2")
    df = scan_dataset(spark, _ds(base, [{"key": "x", "values": [1, 2]}])).df
    assert df.schema["s"].dataType.simpleString() == "struct<p:int,q:int>"
    assert sorted((r.x, r.s.p, r.s.q) for r in df.collect()) == [(1, 1, None), (2, None, 2)]


def test_incompatible_types_fail(spark, scratch):
    base = f"{scratch}/t"
    spark.createDataFrame([(True,)], "a boolean").write.parquet(f"{base}/p=1")
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{base}/p=2")
    with pytest.raises(Exception):
        scan_dataset(spark, _ds(base, [{"key": "p", "values": [1, 2]}])).df.collect()


def test_holes_are_skipped_and_reported(spark, scratch):
    base = f"{scratch}/t"
    for p in (1, 2):
        spark.createDataFrame([(p, p * 10)], "id int, v int").write.parquet(f"{base}/p={p}")
    os.makedirs(f"{base}/p=3")
    open(f"{base}/p=3/_SUCCESS", "w").close()          # leaf with only a marker
    os.makedirs(f"{base}/p=4")
    with open(f"{base}/p=4/notes.txt", "w") as fh:     # leaf with a non-Parquet file
        fh.write("not parquet")
    scan = scan_dataset(spark, _ds(base, [{"key": "p", "values": [1, 2, 3, 4, 5]}]))
    assert sorted(r.id for r in scan.df.collect()) == [1, 2]
    cov = {r.p: (r.status, r.files, r.rows) for r in scan.coverage().collect()}
    assert cov["1"][0] == cov["2"][0] == "found" and cov["1"][1] >= 1 and cov["1"][2] == 1
    assert cov["3"][0] == "missing" and cov["5"][0] == "missing"
    assert cov["4"][0] == "unreadable"


def test_all_missing_is_an_error(spark, events_base):
    with pytest.raises(ScanError, match="No data loaded"):
        scan_dataset(spark, _ds(events_base, [{"key": "event_date", "values": ["1999-01-01"]},
                                              {"key": "event_type", "values": ["click"]}]))
    with pytest.raises(ScanError):
        scan_dataset(spark, DatasetSpec("x", "/nonexistent/sqlrun/path"))


def test_one_glob_per_first_level_value_feeds_one_scan(spark, events_base):
    from sqlrun.sources.hive_paths import leaf_globs

    dates = EVENT_DATES + [f"2030-01-{d:02d}" for d in range(1, 29)]
    ds = _ds(events_base, [{"key": "event_date", "values": dates + dates[:3]},
                           {"key": "event_type", "values": EVENT_TYPES}])
    globs = leaf_globs(ds)
    assert len(globs) == 58
    assert globs[0].endswith("/event_date=2024-01-01/{event_type=click,event_type=error,"
                             "event_type=purchase,event_type=signup,event_type=view}")
    scan = scan_dataset(spark, ds)
    assert len(scan.globs) == 1  # one listing of the base folder finds what exists
    full = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    dup = full.filter(F.to_date("ts").cast("string").isin(dates[:3])).count()
    assert scan.df.count() == full.count() + dup


@pytest.mark.parametrize("bad,match", [
    ({"partitions": [{"key": "k", "values": []}]}, "empty values"),
    ({"partitions": [{"values": [1]}]}, "missing 'key'"),
    ({"partitions": [{"key": "k"}]}, "missing 'values'"),
    ({"partitions": [{"key": "k", "values": "abc"}]}, "must be a list"),
    ({"partitions": [{"key": "k", "values": [1]}, {"key": "K", "values": [2]}]}, "twice"),
    ({"name": "a-b"}, "identifier"),
    ({"path": "  "}, "empty path"),
])
def test_spec_checks(bad, match):
    ds = {"name": "t", "path": "/x", **bad}
    with pytest.raises(SpecError, match=match):
        RunSpec.from_dict({"datasets": [ds], "query": "SELECT 1"})


def test_duplicate_dataset_names_rejected():
    with pytest.raises(SpecError, match="twice"):
        RunSpec.from_dict({"datasets": [{"name": "a", "path": "/x"}, {"name": "A", "path": "/y"}],
                           "query": "SELECT 1"})


def test_partition_key_dataclass_roundtrip():
    pk = PartitionKey("k", (1, 2))
    ds = DatasetSpec("t", "/b/", (pk,))
    assert ds.base_path == "/b" and ds.leaf_count == 2


def test_coverage_of_catalogue_spec(spark, events_base):
    res = run(spark, {"datasets": [{"name": "ev", "path": events_base, "partitions": [
        {"key": "event_date", "values": ["2024-01-01", "2099-01-01"]},
        {"key": "event_type", "values": ["click", "click"]}]}], "query": "SELECT * FROM ev"})
    cov = res.coverage().orderBy("leaf_index").collect()
    assert [r.leaf_index for r in cov] == [0, 1, 2, 3]
    assert [r.status for r in cov] == ["found", "found", "missing", "missing"]
    assert cov[0].rows == cov[1].rows and cov[0].bytes > 0
    assert res.df.count() == 2 * cov[0].rows


def test_coverage_and_scan_over_several_glob_chunks(spark, events_base):
    from sqlrun.sources.hive_paths import leaf_globs

    fake = [f"2031-02-{d:02d}" for d in range(1, 29)] + [f"2031-03-{d:02d}" for d in range(1, 13)]
    dates = fake + EVENT_DATES        # 70 values -> 70 globs, 30 live
    ds = _ds(events_base, [{"key": "event_date", "values": dates},
                           {"key": "event_type", "values": ["click"]}])
    assert len(leaf_globs(ds)) == 70
    scan = scan_dataset(spark, ds)
    assert len(scan.globs) == 1
    flat = spark.read.parquet(f"{SF_SMALL}/events.parquet").filter("event_type = 'click'").count()
    assert scan.df.count() == flat
    cov = scan.coverage().collect()
    assert len(cov) == 70
    assert sum(r.rows for r in cov) == flat
    assert {r.status for r in cov if r.event_date in fake} == {"missing"}


def test_unreadable_first_leaf_and_marker_only_spec(spark, scratch):
    base = f"{scratch}/t"
    os.makedirs(f"{base}/p=0")
    with open(f"{base}/p=0/bad.parquet", "w") as fh:   # first listed leaf is unreadable
        fh.write("garbage")
    spark.createDataFrame([(1, "x")], "id int, s string").write.parquet(f"{base}/p=1")
    scan = scan_dataset(spark, _ds(base, [{"key": "p", "values": [0, 1]}]))
    assert [tuple(r) for r in scan.df.collect()] == [(1, "x", 1)]
    assert {r.p: r.status for r in scan.coverage().collect()} == {"0": "unreadable", "1": "found"}
    os.makedirs(f"{scratch}/m/p=1")
    open(f"{scratch}/m/p=1/_SUCCESS", "w").close()
    with pytest.raises(ScanError, match="No data loaded"):
        scan_dataset(spark, _ds(f"{scratch}/m", [{"key": "p", "values": [1]}]))


def test_same_folder_listed_as_text_and_int_counts_twice(spark, scratch):
    base = f"{scratch}/t"
    spark.createDataFrame([(1, 1), (2, 2)], "id int, k int").write.partitionBy("k").parquet(base)
    df = scan_dataset(spark, _ds(base, [{"key": "k", "values": [1, "1", 2]}])).df
    assert dict(df.dtypes)["k"] == "string"
    assert sorted(r.id for r in df.collect()) == [1, 1, 2]


def test_parity_with_leaf_union_over_evolved_schemas(spark):
    base = fx.events_evolved(spark, SF_SMALL)
    parts = [{"key": "event_type", "values": EVENT_TYPES}]
    ours = scan_dataset(spark, _ds(base, parts)).df
    naive = naive_union(spark, base, parts)
    assert set(ours.columns) == set(naive.columns)
    assert dict(ours.dtypes)["event_id"] == "bigint"
    assert same_bag(naive, ours)


def test_layout_writer_splits_a_hot_value(spark, scratch):
    from sqlrun.catalog.fixtures import write_partitioned

    s = spark.newSession()
    s.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    ev = s.read.parquet(f"{SF_SMALL}/events.parquet")
    hot = ev.withColumn("k", F.when(F.col("event_id") % 3 == 0, F.lit("hot"))
                        .otherwise(F.col("event_type")))
    write_partitioned(hot.unionByName(hot).unionByName(hot), f"{scratch}/w", "k")
    files = [f for f in os.listdir(f"{scratch}/w/k=hot") if f.endswith(".parquet")]
    assert len(files) > 1


def test_case_insensitive_overlap_takes_key_spelling_and_value(spark, scratch):
    base = f"{scratch}/t"
    spark.createDataFrame([(1, "WRONG")], "id int, Event_Type string").write.parquet(f"{base}/event_type=click")
    df = scan_dataset(spark, _ds(base, [{"key": "event_type", "values": ["click"]}])).df
    assert df.columns == ["id", "event_type"]
    assert [tuple(r) for r in df.collect()] == [(1, "click")]


def test_flat_dataset_schema_modes(spark, scratch):
    base = f"{scratch}/t"
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{base}/p=1")
    spark.createDataFrame([(2, 3)], "a int, b int").write.parquet(f"{base}/p=2")
    merged = scan_dataset(spark, _ds(base, [], schema_mode="merge")).df
    assert set(merged.columns) == {"a", "b", "p"}
    first = scan_dataset(spark, _ds(base, [])).df
    assert len(first.columns) in (2, 3)   # one footer decides, as a plain Spark read


_VALUE_CHARS = st.sampled_from(list("ab9 _-.:/=%*?,{}[]^\\\"'#~@!$&()+;<>|`") + ["é", "中"] + ["\t", "\x01", "\x7f", "\n"])


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.text(_VALUE_CHARS, min_size=1, max_size=6).filter(lambda s: s.strip() == s),
                       min_size=1, max_size=5, unique=True))
def test_any_value_written_by_spark_is_found(spark, values):
    import tempfile

    base = tempfile.mkdtemp(prefix="sqlrun-prop-") + "/t"
    rows = [(i, v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "id int, k string").write.partitionBy("k").parquet(base)
    df = scan_dataset(spark, _ds(base, [{"key": "k", "values": values}])).df
    assert sorted((r.id, r.k) for r in df.collect()) == sorted(rows)


def test_dotted_key_and_large_spec_index(spark, scratch):
    base = f"{scratch}/t"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, `k.x` string") \
        .write.partitionBy("k.x").parquet(base)
    scan = scan_dataset(spark, _ds(base, [{"key": "k.x", "values": ["a", "b", "a"]}]))
    assert sorted(r.id for r in scan.df.collect()) == [1, 1, 2]
    cov = scan.coverage().orderBy("leaf_index").collect()
    assert [(r["k.x"], r.status, r.rows) for r in cov] == [("a", "found", 1), ("b", "found", 1), ("a", "found", 1)]


def test_footer_survey_returns_one_sample_per_distinct_schema(spark):
    from sqlrun.sources import footers

    base = fx.events_evolved(spark, SF_SMALL)
    globs = [f"{base}/event_type={t}" for t in EVENT_TYPES]
    survey = footers.survey(spark, globs, ["event_type"], [{t: k for k, t in enumerate(EVENT_TYPES)}])
    files = spark.read.format("binaryFile").load(globs).count()
    assert files > 2
    assert len(survey.groups) == 2 and survey.bad_leaves == [] and survey.bad_files == []
    assert sorted(sum((g.paths for g in survey.groups), [])) == sorted(
        f"file:{base}/event_type={t}".replace("file:file:", "file:") for t in EVENT_TYPES)
    types = [dict(spark.read.parquet(g.sample).dtypes)["event_id"] for g in survey.groups]
    assert types == ["int", "bigint"]  # in the order of the first leaves


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(dates=st.lists(st.sampled_from(EVENT_DATES[:4] + ["2099-01-01"]), min_size=1, max_size=3),
       hours=st.lists(st.integers(min_value=0, max_value=25), min_size=1, max_size=4),
       types=st.lists(st.sampled_from(["click", "view", "nope"]), min_size=1, max_size=3))
def test_three_level_parity_with_int_level(spark, dates, hours, types):
    base = fx.events_by_day_hour_type(spark, SF_SMALL)
    parts = [{"key": "event_date", "values": dates}, {"key": "hour", "values": hours},
             {"key": "event_type", "values": types}]
    try:
        naive = naive_union(spark, base, parts)
    except IndexError:  # nothing listed exists
        with pytest.raises(ScanError):
            scan_dataset(spark, _ds(base, parts))
        return
    ours = scan_dataset(spark, _ds(base, parts)).df
    assert dict(ours.dtypes)["hour"] == "int"
    assert dict(ours.dtypes) == dict(naive.dtypes)
    assert same_bag(naive, ours)


def test_scan_dataset_accepts_a_dict(spark, events_base):
    scan = scan_dataset(spark, {"name": "ev", "path": events_base,
                                "partitions": [{"key": "event_date", "values": ["2024-01-01"]},
                                               {"key": "event_type", "values": ["view"]}]})
    flat = spark.read.parquet(f"{SF_SMALL}/events.parquet") \
        .filter("to_date(ts) = DATE'2024-01-01' AND event_type = 'view'").count()
    assert scan.df.count() == flat
    with pytest.raises(SpecError):
        scan_dataset(spark, {"name": "bad name", "path": events_base})


def test_reuse_decision_for_inferred_partition_types():
    from sqlrun.sources.partition_scan import _text_survives

    assert _text_survives("2024-01-05", T.DateType())
    assert not _text_survives("2024-1-5", T.DateType())
    assert not _text_survives("20240105", T.DateType())
    assert _text_survives("42", T.IntegerType()) and _text_survives("-7", T.LongType())
    assert not _text_survives("08", T.IntegerType())
    assert not _text_survives("1.50", T.DoubleType())


def test_declared_schema_with_missing_values(spark, events_base):
    ds = _ds(events_base, [{"key": "event_date", "values": ["2024-01-01", "2099-01-01"]},
                           {"key": "event_type", "values": ["view", "click", "view"]}],
             schema="event_id BIGINT, user_id BIGINT, value DOUBLE")
    scan = scan_dataset(spark, ds)
    assert scan.df.columns == ["event_id", "user_id", "value", "event_date", "event_type"]
    flat = spark.read.parquet(f"{SF_SMALL}/events.parquet").filter("to_date(ts) = DATE'2024-01-01'")
    expected = flat.filter("event_type = 'click'").count() + 2 * flat.filter("event_type = 'view'").count()
    assert scan.df.count() == expected


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(dates=st.lists(st.sampled_from(EVENT_DATES[:6] + ["2099-01-01"]), min_size=1, max_size=4),
       types=st.lists(st.sampled_from(EVENT_TYPES + ["none"]), min_size=1, max_size=3))
def test_coverage_property(spark, events_base, dates, types):
    flat = spark.read.parquet(f"{SF_SMALL}/events.parquet") \
        .withColumn("event_date", F.to_date("ts").cast("string"))
    per_leaf = {(r.event_date, r.event_type): r["count"]
                for r in flat.groupBy("event_date", "event_type").count().collect()}
    if not any(per_leaf.get((d, t)) for d in dates for t in types):
        return
    scan = scan_dataset(spark, _ds(events_base, [{"key": "event_date", "values": dates},
                                                  {"key": "event_type", "values": types}]))
    cov = scan.coverage().collect()
    assert sorted(r.leaf_index for r in cov) == list(range(len(dates) * len(types)))
    for r in cov:
        assert (r.event_date, r.event_type) == (dates[r.leaf_index // len(types)],
                                                 types[r.leaf_index % len(types)])
        n = per_leaf.get((r.event_date, r.event_type), 0)
        assert r.status == ("found" if n else "missing")
        assert r.rows == n
        assert (r.files > 0) == bool(n)


def test_repeated_null_value_doubles_its_rows(spark, scratch):
    base = f"{scratch}/t"
    spark.createDataFrame([(1, None), (2, "a"), (3, None)], "id int, k string") \
        .write.partitionBy("k").parquet(base)
    scan = scan_dataset(spark, _ds(base, [{"key": "k", "values": [None, "a", None]}]))
    assert sorted(r.id for r in scan.df.collect()) == [1, 1, 2, 3, 3]
    cov = {r.leaf_index: (r.k, r.status, r.rows) for r in scan.coverage().collect()}
    assert cov == {0: (None, "found", 2), 1: ("a", "found", 1), 2: (None, "found", 2)}


def test_string_array_keeps_any_text(spark):
    from sqlrun.operators.coverage import string_array

    vals = ["plain", "it's", "back\\slash", "new\nline", "50%_", "\\u0041", "中文", None, ""]
    assert spark.range(1).select(string_array(spark, vals + ["${env:HOME}"]).alias("a")) \
        .first()["a"][-1] == "${env:HOME}"
    got = spark.range(1).select(string_array(spark, vals).alias("a")).first()["a"]
    assert got == vals
