"""The range join against brute force, and its plan."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sqlrun.operators.range_join import range_join

BOUNDS = st.one_of(st.none(), st.integers(-50, 50).map(float), st.floats(allow_nan=True, allow_infinity=True),
                   st.sampled_from([0.0, -0.0, 1e300, -1e300, 1e-300, 2.0 ** 53, 2.0 ** 53 + 2]))


def brute(points, intervals, closed):
    nan = lambda x: x != x
    return sorted((p, k) for p, x in points for k, a, b in intervals if None not in (x, a, b) and not any(map(nan, (x, a, b)))
                  and a <= x and (x <= b if closed else x < b))


def joined(spark, points, intervals, kind, closed=False):
    left = spark.createDataFrame(points, f"p int, x {kind}")
    right = spark.createDataFrame(intervals, f"k int, lo {kind}, hi {kind}")
    return range_join(left, right, "x", "lo", "hi", closed)


@settings(max_examples=25, deadline=None)
@given(points=st.lists(BOUNDS, min_size=1, max_size=12), intervals=st.lists(st.tuples(BOUNDS, BOUNDS), min_size=1, max_size=12),
       closed=st.booleans())
def test_equals_brute_force(spark, points, intervals, closed):
    p, i = list(enumerate(points)), [(k, *ab) for k, ab in enumerate(intervals)]
    got = joined(spark, p, i, "double", closed)
    assert sorted((r.p, r.k) for r in got.collect()) == brute(p, i, closed)


@pytest.mark.parametrize("kind", ["int", "bigint", "float", "decimal(12,3)", "date", "timestamp", "timestamp_ntz"])
def test_types(spark, kind):
    import decimal
    rng = random.Random(kind)
    make = {"date": lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n),
            "timestamp": lambda n: dt.datetime(2024, 3, 30, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=7 * n),
            "timestamp_ntz": lambda n: dt.datetime(2024, 3, 30) + dt.timedelta(minutes=7 * n, microseconds=n),
            "decimal(12,3)": lambda n: decimal.Decimal(n) / 8, "float": lambda n: n / 4}.get(kind, lambda n: n * 1000)
    points = [(k, make(rng.randrange(400))) for k in range(150)]
    starts = [(rng.randrange(400), rng.choice((0, 1, 5, 90, 390))) for _ in range(60)]
    intervals = [(k, make(a), make(a + n)) for k, (a, n) in enumerate(starts)]
    got = joined(spark, points, intervals, kind)
    assert sorted((r.p, r.k) for r in got.collect()) == brute(points, intervals, False)


def test_rows_repeat_and_sides_may_be_empty(spark):
    points, intervals = [(1, 5.0), (1, 5.0)], [(7, 0.0, 10.0), (7, 0.0, 10.0), (8, 5.0, 5.0)]
    assert joined(spark, points, intervals, "double").count() == 4
    none = spark.createDataFrame([], "p int, x double")
    bands = spark.createDataFrame(intervals, "k int, lo double, hi double")
    assert range_join(none, bands, "x", "lo", "hi").collect() == []
    got = range_join(spark.createDataFrame(points, "p int, x double"), bands.limit(0), "x", "lo", "hi")
    assert got.collect() == [] and got.columns == ["p", "x", "k", "lo", "hi"]


def test_plan_has_no_nested_loop(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    left = s.range(5000).selectExpr("id AS p", "id * 1.5D AS x")
    right = s.range(500).selectExpr("id AS k", "id * 10D AS lo", "id * 10D + 25 AS hi")
    df = range_join(left, right, "x", "lo", "hi")
    assert df.count() == left.crossJoin(right).filter("lo <= x AND x < hi").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_refusals(spark):
    text = spark.createDataFrame([("a",)], "x string")
    bands = spark.createDataFrame([(1.0, 2.0)], "lo double, hi double")
    with pytest.raises(TypeError):
        range_join(text, bands, "x", "lo", "hi")
    with pytest.raises(ValueError, match="both sides"):
        range_join(bands, bands, "lo", "lo", "hi")
    days = spark.createDataFrame([(dt.date(2024, 1, 1),)], "x date")
    with pytest.raises(TypeError, match="one type"):
        range_join(days, bands, "x", "lo", "hi")
