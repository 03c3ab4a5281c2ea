"""The run pipeline: registration, view chain, parameters, override,
session isolation, profile, sink."""

import json
import os

import pytest

from sqlrun import RunSpec, SpecError, ViewError, manifest, manifest_summary, preview, run
from sqlrun.catalog import fixtures as fx
from sqlrun.catalog.common import events_ds, flat
from sqlrun.plans.runner import DEFAULT_PROFILE, apply_profile
from sqlrun.sources.result_sink import SinkError, output_path, write_result

from .conftest import EVENT_DATES, EVENT_TYPES, SF_SMALL


def _spec(spark, **kw):
    return {"datasets": [events_ds(spark, SF_SMALL), flat(SF_SMALL, "customer")],
            "query": "SELECT COUNT(*) AS n FROM ev", **kw}


def test_views_run_in_order_and_see_earlier_ones(spark):
    res = run(spark, _spec(spark, views=[
        {"name": "a", "sql": "CREATE TEMPORARY VIEW a AS SELECT user_id FROM ev WHERE value > ${V}"},
        {"name": "b", "sql": "CREATE TEMPORARY VIEW b AS SELECT COUNT(*) AS n FROM a"},
        {"name": "blank", "sql": "  "},
    ], parameters={"V": 10}, query="SELECT n FROM b"))
    flat_n = spark.read.parquet(f"{SF_SMALL}/events.parquet").filter("value > 10").count()
    assert res.df.collect()[0].n == flat_n


def test_view_failure_names_the_view(spark):
    with pytest.raises(ViewError, match="broken"):
        run(spark, _spec(spark, views=[{"name": "broken", "sql": "CREATE TEMPORARY VIEW x AS SELECT nope FROM ev"}]))


def test_view_files_read_through_spark(spark, scratch):
    path = os.path.join(scratch, "v.sql")
    with open(path, "w") as fh:
        fh.write("CREATE TEMPORARY VIEW big AS SELECT * FROM customer WHERE c_acctbal > ${MIN};\n")
    res = run(spark, _spec(spark, views=[path], parameters={"MIN": 0},
                           query="SELECT COUNT(*) AS n FROM big"))
    assert res.df.collect()[0].n == spark.read.parquet(f"{SF_SMALL}/customer.parquet") \
        .filter("c_acctbal > 0").count()


def test_missing_view_file_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        run(spark, _spec(spark, views=["/nonexistent/view.sql"]))


def test_sql_function_and_set_in_view_chain(spark):
    res = run(spark, _spec(spark, views=[
        {"name": "conf", "sql": "SET spark.sql.shuffle.partitions = 3"},
        {"name": "fn", "sql": "CREATE TEMPORARY FUNCTION twice(x BIGINT) RETURNS BIGINT RETURN x * 2"},
    ], query="SELECT twice(COUNT(*)) AS n FROM ev"))
    assert res.df.collect()[0].n == 2 * spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert res.session.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_typed_args_and_identifier(spark):
    res = run(spark, _spec(spark, query="SELECT COUNT(*) AS n FROM IDENTIFIER(:t) WHERE c_acctbal > :m"),
              args={"t": "customer", "m": 1000.0})
    assert res.df.collect()[0].n == spark.read.parquet(f"{SF_SMALL}/customer.parquet") \
        .filter("c_acctbal > 1000").count()


def test_query_override_wins_and_blank_override_is_ignored(spark):
    res = run(spark, _spec(spark), query="SELECT COUNT(*) AS n FROM customer")
    assert res.df.collect()[0].n == 150
    res = run(spark, _spec(spark), query="   ")
    assert res.df.collect()[0].n == 1000


def test_run_session_is_isolated(spark):
    res = run(spark, _spec(spark))
    assert res.session is not spark
    assert "ev" not in [t.name for t in spark.catalog.listTables()]
    assert "ev" in [t.name for t in res.session.catalog.listTables()]


def test_profile_replaces_defaults_and_skips_launch_confs(spark):
    s = spark.newSession()
    skipped = apply_profile(s, {"spark.sql.shuffle.partitions": "5",
                                "spark.default.parallelism": "9",
                                "spark.executor.memory": "4g",
                                "spark.sql.warehouse.dir": "/elsewhere",
                                "spark.hadoop.fs.sqlrun.test.key": "v1",
                                "custom.user.key": "v2"})
    assert s.conf.get("spark.sql.shuffle.partitions") == "5"
    assert s.conf.get("fs.sqlrun.test.key") == "v1"
    assert s.conf.get("custom.user.key") == "v2"
    assert set(skipped) == {"spark.default.parallelism", "spark.executor.memory",
                            "spark.sql.warehouse.dir"}
    s2 = spark.newSession()
    assert apply_profile(s2, {}) == []
    assert s2.conf.get("spark.sql.adaptive.enabled") == DEFAULT_PROFILE["spark.sql.adaptive.enabled"]


def test_run_spec_checks():
    with pytest.raises(SpecError):
        RunSpec.from_dict({"datasets": [], "query": "SELECT 1"})
    with pytest.raises(SpecError):
        RunSpec.from_dict({"datasets": [{"name": "a", "path": "/x"}], "query": 1})
    with pytest.raises(SpecError, match="'views' must be a list"):
        RunSpec.from_dict({"datasets": [{"name": "a", "path": "/x"}], "query": "SELECT 1",
                           "views": "v.sql"})
    with pytest.raises(SpecError, match="'partitions' must be a list"):
        RunSpec.from_dict({"datasets": [{"name": "a", "path": "/x", "partitions": {"key": "k"}}],
                           "query": "SELECT 1"})
    with pytest.raises(SpecError, match="parameters"):
        RunSpec.from_dict({"datasets": [{"name": "a", "path": "/x"}], "query": "SELECT 1",
                           "parameters": ["A", 1]})
    with pytest.raises(SpecError, match="outputPrefix"):
        RunSpec.from_dict({"datasets": [{"name": "a", "path": "/x"}], "query": "SELECT 1"},
                          require_output=True)


def test_empty_query_rejected(spark):
    with pytest.raises(SpecError, match="empty"):
        run(spark, _spec(spark, query="  "))


def test_run_spec_from_json_file(spark, scratch):
    spec = _spec(spark, outputPrefix=scratch + "/out", query="SELECT event_type, COUNT(*) AS n FROM ev GROUP BY 1")
    path = os.path.join(scratch, "spec.json")
    with open(path, "w") as fh:
        json.dump(spec, fh)
    loaded = RunSpec.load(spark, path, require_output=True)
    res = run(spark, loaded)
    out = res.write(run_id="r1")
    assert out == scratch + "/out/r1"
    assert spark.read.parquet(out).count() == 5


def test_sink_write_preview_manifest(spark, scratch):
    res = run(spark, _spec(spark, query="SELECT * FROM ev ORDER BY event_id"))
    path = write_result(res.df, scratch + "/res/", "abc")
    assert path == scratch + "/res/abc"
    back = spark.read.parquet(path)
    assert back.count() == 1000
    # a sorted result keeps its order across part files: files in name order,
    # each sorted, concatenate to the sorted sequence
    from pyspark.sql import functions as F
    rows = back.select("event_id", F.input_file_name().alias("f")).collect()
    by_file: dict = {}
    for r in rows:
        by_file.setdefault(r.f, []).append(r.event_id)
    seq = [v for f in sorted(by_file) for v in sorted(by_file[f])]
    assert seq == sorted(seq)
    assert preview(spark, path, 7).count() == 7
    m = manifest_summary(spark, path).collect()[0]
    assert m.files >= 1 and m.bytes > 0
    assert manifest(spark, path).count() == m.files
    # overwrite at the same run id
    write_result(res.df.limit(3), scratch + "/res", "abc")
    assert spark.read.parquet(path).count() == 3


def test_sink_rejects_duplicate_columns_and_empty_prefix(spark, scratch):
    res = run(spark, _spec(spark, query="SELECT user_id, user_id FROM ev"))
    with pytest.raises(SinkError, match="duplicate"):
        write_result(res.df, scratch, "x")
    with pytest.raises(SinkError):
        output_path("  ")
    with pytest.raises(SinkError, match="run id"):
        output_path("/p", "a/b")


def test_empty_result_keeps_schema(spark, scratch):
    res = run(spark, _spec(spark, query="SELECT user_id, value FROM ev WHERE value < -1"))
    path = write_result(res.df, scratch, "empty")
    back = spark.read.parquet(path)
    assert back.count() == 0 and back.columns == ["user_id", "value"]


def test_result_uuid_paths_differ():
    assert output_path("/p") != output_path("/p")


def test_layout_root_uses_shared_folder(spark):
    root = fx.layout_root(spark, SF_SMALL)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert root.startswith(shared.rstrip("/"))


def test_listing_and_shuffle_width_sized_to_cluster_unless_given(spark):
    from sqlrun.plans.runner import INITIAL_SHUFFLE_PARTITIONS, LISTING_PARALLELISM

    cores = spark.sparkContext.defaultParallelism
    res = run(spark, _spec(spark))
    assert res.session.conf.get(LISTING_PARALLELISM) == str(max(8, 2 * cores))
    shuffle = int(res.session.conf.get("spark.sql.shuffle.partitions"))
    assert res.session.conf.get(INITIAL_SHUFFLE_PARTITIONS) == str(max(shuffle, 4 * cores))
    res = run(spark, _spec(spark, sparkSessionConfig={LISTING_PARALLELISM: "123",
                                                      INITIAL_SHUFFLE_PARTITIONS: "77"}))
    assert res.session.conf.get(LISTING_PARALLELISM) == "123"
    assert res.session.conf.get(INITIAL_SHUFFLE_PARTITIONS) == "77"


def test_preview_of_folder_without_parquet(spark, scratch):
    with pytest.raises(SinkError, match="no Parquet"):
        preview(spark, scratch, 5)


def test_command_line_entry(spark, scratch, capsys):
    from sqlrun.plans.runner import main

    spec = {"datasets": [flat(SF_SMALL, "nation")], "query": "SELECT * FROM nation",
            "outputPrefix": scratch + "/cli"}
    path = os.path.join(scratch, "spec.json")
    with open(path, "w") as fh:
        json.dump(spec, fh)
    assert main([path, "run-7"]) == 0
    out = capsys.readouterr().out.strip()
    assert out == scratch + "/cli/run-7"
    assert spark.read.parquet(out).count() == 25
    assert main([path, "run-8", "--query", "SELECT n_regionkey, COUNT(*) AS n FROM nation "
                 "GROUP BY n_regionkey", "--preview", "3"]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert lines[0] == scratch + "/cli/run-8"
    assert spark.read.parquet(lines[0]).count() == 5
    assert "n_regionkey" in lines[2]
    assert main([path]) == 0            # run id defaults to a new UUID
    auto = capsys.readouterr().out.strip()
    assert auto.startswith(scratch + "/cli/") and len(auto.rsplit("/", 1)[1]) == 36
    assert main([]) == 1


def test_typed_args_reach_views_and_other_statements(spark):
    res = run(spark, _spec(spark, views=[
        {"name": "conf", "sql": "SET spark.sql.shuffle.partitions = 4"},
        {"name": "fn", "sql": "CREATE TEMPORARY FUNCTION plus1(x BIGINT) RETURNS BIGINT RETURN x + 1"},
        {"name": "v", "sql": "CREATE TEMPORARY VIEW rich AS SELECT * FROM customer WHERE c_acctbal > :m"},
    ], query="SELECT plus1(COUNT(*)) AS n FROM rich WHERE c_mktsegment = :seg"),
        args={"m": 1000.0, "seg": "BUILDING"})
    expected = spark.read.parquet(f"{SF_SMALL}/customer.parquet") \
        .filter("c_acctbal > 1000 AND c_mktsegment = 'BUILDING'").count()
    assert res.df.collect()[0].n == expected + 1


def test_plain_query_in_view_chain_is_dropped_with_a_warning(spark, caplog):
    from sqlrun.plans.runner import _is_plain_query

    assert _is_plain_query("-- note\n  select 1") and _is_plain_query("WITH a AS (SELECT 1) SELECT * FROM a")
    assert not _is_plain_query("CREATE TEMPORARY VIEW v AS SELECT 1")
    assert not _is_plain_query("SET x = 1")
    with caplog.at_level("WARNING", logger="sqlrun"):
        res = run(spark, _spec(spark, views=[{"name": "q", "sql": "SELECT 1/0 AS boom"}]))
    assert res.df.collect()[0].n == 1000
    assert any("result is dropped" in r.message for r in caplog.records)


def test_yaml_run_config_with_view_files(spark, scratch):
    events = fx.events_by_day_type(spark, SF_SMALL)
    view = os.path.join(scratch, "create_metrics_view.sql")
    with open(view, "w") as fh:
        fh.write("CREATE TEMPORARY VIEW daily_metrics AS\n"
                 "SELECT event_date, event_type AS region, COUNT(*) AS total_events,\n"
                 "       COUNT(DISTINCT user_id) AS unique_users\n"
                 "FROM events WHERE event_date >= '${START_DATE}'\n"
                 "GROUP BY event_date, event_type\n")
    cfg = f"""
applicationId: ignored-here
awsRegion: ignored-here
outputPrefix: {scratch}/results/
datasets:
  - name: events
    path: {events}/
    partitions:
      - key: event_date
        values:
          - 2024-01-01
          - "2024-01-02"
      - key: event_type
        values: [click, view]
  - name: users
    path: {SF_SMALL}/customer.parquet
views:
  - {view}
parameters:
  START_DATE: "2024-01-01"
  LIMIT: 5
query: |
  SELECT region, SUM(total_events) AS n FROM daily_metrics GROUP BY region ORDER BY region LIMIT ${{LIMIT}}
sparkSubmitConfig:
  spark.executor.memory: "32G"
"""
    path = os.path.join(scratch, "query.yaml")
    with open(path, "w") as fh:
        fh.write(cfg)
    spec = RunSpec.load(spark, path, require_output=True)
    assert spec.datasets[0].partitions[0].values == ("2024-01-01", "2024-01-02")
    res = run(spark, spec)
    flat = spark.read.parquet(f"{SF_SMALL}/events.parquet") \
        .filter("to_date(ts) IN (DATE'2024-01-01', DATE'2024-01-02') AND event_type IN ('click', 'view')")
    expected = {r.event_type: r["count"] for r in flat.groupBy("event_type").count().collect()}
    assert {r.region: r.n for r in res.df.collect()} == expected
    out = res.write(run_id="y1")
    assert out == f"{scratch}/results/y1"


def test_empty_spec_documents_rejected():
    with pytest.raises(SpecError, match="empty"):
        RunSpec.from_json("  \n")
    with pytest.raises(SpecError, match="empty"):
        RunSpec.from_yaml("")


def test_coverage_over_two_partitioned_datasets(spark):
    orders = {"name": "orders", "path": fx.orders_by_year(spark, SF_SMALL),
              "partitions": [{"key": "o_year", "values": [1995, 2099]}]}
    res = run(spark, {"datasets": [events_ds(spark, SF_SMALL, dates=["2024-01-01"], types=["view"]),
                                   orders], "query": "SELECT 1 AS x"})
    cov = res.coverage().collect()
    assert sorted((r.dataset, r.status) for r in cov) == [
        ("ev", "found"), ("orders", "found"), ("orders", "missing")]
    by_ds = {r.dataset: r for r in cov if r.status == "found"}
    assert by_ds["ev"].event_type == "view" and by_ds["ev"].o_year is None
    assert by_ds["orders"].o_year == "1995" and by_ds["orders"].rows > 0


def test_load_report(spark):
    res = run(spark, {"datasets": [events_ds(spark, SF_SMALL, dates=["2024-01-01", "2099-01-01"],
                                             types=["view", "click"])], "query": "SELECT 1 AS x"})
    r = res.load_report().collect()[0]
    assert (r.dataset, r.requested, r.found, r.missing, r.unreadable) == ("ev", 4, 2, 2, 0)
    assert r.files >= 2 and r.bytes > 0


def test_sql_script_in_view_chain(spark):
    script = """BEGIN
  CREATE OR REPLACE TEMPORARY VIEW clicks AS SELECT * FROM ev WHERE event_type = 'click';
  CREATE OR REPLACE TEMPORARY VIEW click_users AS SELECT DISTINCT user_id FROM clicks;
END;"""
    res = run(spark, _spec(spark, views=[{"name": "script", "sql": script}],
                           query="SELECT COUNT(*) AS n FROM click_users"))
    flat = spark.read.parquet(f"{SF_SMALL}/events.parquet").filter("event_type = 'click'")
    assert res.df.collect()[0].n == flat.select("user_id").distinct().count()


def test_parameters_do_not_touch_dataset_paths(spark):
    from sqlrun import ScanError

    spec = {"datasets": [{"name": "t", "path": SF_SMALL + "/${TABLE}.parquet"}],
            "query": "SELECT * FROM t", "parameters": {"TABLE": "nation"}}
    with pytest.raises(ScanError):
        run(spark, spec)


def test_explain_prints_the_pruned_scan(spark, capsys):
    res = run(spark, _spec(spark, query="SELECT user_id FROM ev WHERE event_date = '2024-01-02'"))
    res.explain()
    out = capsys.readouterr().out
    assert "PartitionFilters" in out and "2024-01-02" in out


def test_further_queries_reuse_the_run(spark):
    res = run(spark, _spec(spark, parameters={"T": "click"}))
    df = res.sql("SELECT COUNT(*) AS n FROM ev WHERE event_type = '${T}' AND value > :v", args={"v": 10.0})
    flat = spark.read.parquet(f"{SF_SMALL}/events.parquet").filter("event_type = 'click' AND value > 10")
    assert df.collect()[0].n == flat.count()
    with pytest.raises(SpecError):
        res.sql("  ")


def test_substituted_sql_is_logged(spark, caplog):
    with caplog.at_level("INFO", logger="sqlrun"):
        run(spark, _spec(spark, parameters={"T": "view"},
                         query="SELECT COUNT(*) AS n FROM ev WHERE event_type = '${T}'"))
    assert any("event_type = 'view'" in r.getMessage() for r in caplog.records)


def test_view_named_like_a_dataset_fails(spark):
    with pytest.raises(ViewError, match="ALREADY_EXISTS"):
        run(spark, _spec(spark, views=[{"name": "clash",
                                        "sql": "CREATE TEMPORARY VIEW ev AS SELECT 1 AS x"}]))


def test_undefined_parameter_fails_before_any_dataset_is_read(spark):
    from sqlrun import ParameterError

    spec = {"datasets": [{"name": "t", "path": "/nonexistent/sqlrun/never-listed"}],
            "views": [{"name": "v", "sql": "CREATE TEMPORARY VIEW v AS SELECT ${NOPE}"}],
            "query": "SELECT 1 AS x"}
    with pytest.raises(ParameterError, match="NOPE"):   # not a ScanError: no listing yet
        run(spark, spec)


def test_coverage_needs_a_partitioned_dataset(spark):
    res = run(spark, {"datasets": [flat(SF_SMALL, "nation")], "query": "SELECT * FROM nation"})
    with pytest.raises(ValueError, match="no partitioned dataset"):
        res.coverage()
