"""A written result keeps its order: preview, ordered read-back, ranks."""

import pytest
from pyspark.sql import functions as F

from sqlrun import preview, read_ordered, read_ranked
from sqlrun.sources import result_sink
from sqlrun.sources.result_sink import SinkError, write_result


@pytest.fixture(scope="module")
def sorted_result(spark, tmp_path_factory):
    """20,000 rows sorted by id in many files of unequal size."""
    s = spark.newSession()
    s.conf.set("spark.sql.adaptive.enabled", "false")
    s.conf.set("spark.sql.files.maxRecordsPerFile", "1500")
    s.conf.set("spark.sql.shuffle.partitions", "7")
    rows = s.range(20_000).select((F.lit(19_999) - F.col("id")).alias("id"), F.lit("x").alias("a.b"))
    return write_result(rows.orderBy("id"), str(tmp_path_factory.mktemp("sorted")), "r")


def test_preview_gives_the_first_rows_in_order(spark, sorted_result):
    sizes = {r["count"] for r in spark.read.parquet(sorted_result).groupBy("_metadata.file_name").count().collect()}
    assert len(sizes) > 1
    for n in (0, 1, 5, 1501, 9000, 20_000, 30_000):
        assert [r.id for r in preview(spark, sorted_result, n).collect()] == list(range(min(n, 20_000)))
    got = preview(spark, sorted_result, 4000, rank="place").collect()
    assert [(r.id, r.place, r["a.b"]) for r in got] == [(k, k + 1, "x") for k in range(4000)]


def test_preview_opens_the_first_files_only(spark, sorted_result, monkeypatch):
    opened = []
    read = result_sink._read_files
    monkeypatch.setattr(result_sink, "_read_files", lambda s, df, paths: opened.append(len(paths)) or read(s, df, paths))
    preview(spark, sorted_result, 10).collect()
    assert opened == [1, 1]


def test_read_back_in_order(spark, sorted_result):
    back = read_ordered(spark, sorted_result)
    assert back.columns == ["id", "a.b"]
    assert [r.id for r in back.collect()] == list(range(20_000))


def test_ranks_need_neither_sort_nor_shuffle_of_rows(spark, sorted_result):
    ranked = read_ranked(spark, sorted_result, "place")
    assert ranked.filter("place <> id + 1").count() == 0 and ranked.count() == 20_000
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    rows = [x for x in plan.splitlines() if "Exchange" in x and "id#" in x]
    assert "BroadcastHashJoin" in plan and rows == []


def test_more_parts_than_five_digits_and_more_files_than_three(spark):
    names = ["part-99999-u-c000.snappy.parquet", "part-100000-u-c000.snappy.parquet", "part-00002-u-c1000.snappy.parquet",
             "part-00002-u-c999.snappy.parquet", "other.parquet"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(*result_sink._place(F.col("n")))
    assert [r.file for r in df.orderBy("part", "count", "file").collect()] == [names[k] for k in (4, 3, 2, 0, 1)]


def test_rank_names_must_be_new(spark, sorted_result):
    for read in (lambda: preview(spark, sorted_result, 3, rank="ID"), lambda: read_ranked(spark, sorted_result, "id")):
        with pytest.raises(SinkError, match="already"):
            read()


def test_empty_result_has_an_empty_preview(spark, scratch):
    path = write_result(spark.range(0), scratch, "none")
    assert preview(spark, path, 5, rank="place").collect() == [] and read_ordered(spark, path).collect() == []
    assert read_ranked(spark, path).collect() == []
