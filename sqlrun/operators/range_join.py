"""Range join without an equality: points against the intervals that hold them.

Spark plans ``low <= x AND x < high`` alone as a nested loop over all pairs.
Here both sides get a bin, so that the join has an equality to shuffle by, and
the exact condition is checked on what meets in a bin:

* an interval's *level* is the least power of two that its length doesn't
  exceed, and the bins of a level are that wide, so it spans two bins of its
  own level at most, however long it is (three where rounding adds one);
* a point has one bin on every level that occurs.  Levels are found by an
  aggregate over the intervals, one row for each (as many as there are orders
  of magnitude, never as many as intervals).

A point and an interval meet once at most: the interval has one level, and the
point one bin on it.  A bin with many points is an ordinary skewed join key,
which AQE splits.

Defined results: null bounds and values, NaN, and intervals that are empty or
turned around match nothing; infinite bounds are bounds; equal rows count once
each; an empty side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: bounds beyond are taken as this when bins are found; the level of
# what reaches so far is the last.
_FAR = 2.0 ** 1000
_LAST_LEVEL = 1002


def _number(c: Column, kind: T.DataType) -> Column:
    """Dates as days, times as seconds, all as a double; rounding keeps the
    order, which is all that bins need."""
    if isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, T.TimestampNTZType):  # (without a detour over a time zone, which may turn back)
        c = (F.unix_date(F.to_date(c)) * 86_400.0 + F.hour(c) * 3_600 + F.minute(c) * 60
             + F.date_part(F.lit("SECOND"), c).cast("double"))
    elif not isinstance(kind, T.NumericType):
        raise TypeError(f"a range join needs numbers, dates or timestamps, not {kind.simpleString()}")
    return F.least(F.greatest(c.cast("double"), F.lit(-_FAR)), F.lit(_FAR))


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _bin(x: Column, level: Column) -> Column:
    """Monotonic in x: scaling by a power of two keeps the order."""
    return F.floor(x * F.pow(F.lit(2.0), -level.cast("double")))


def range_join(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str,
               closed: bool = False) -> DataFrame:
    """Inner join: columns of `points`, then of `intervals`, for each pair with
    ``low <= value < high`` (``<= high`` if `closed`).  Columns keep their names;
    names on both sides must be told apart before."""
    clash = {c.lower() for c in points.columns} & {c.lower() for c in intervals.columns}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    kinds = {type(df.schema[c].dataType) for df, c in ((points, value), (intervals, low), (intervals, high))}
    times = {T.DateType, T.TimestampType, T.TimestampNTZType} & kinds
    if times and len(kinds) > 1:
        raise TypeError("value and bounds of a range join must be of one type")
    at, lo, hi = map(_column, (value, low, high))
    x, a, b = (_number(c, df.schema[n].dataType) for c, df, n in (
        (at, points, value), (lo, intervals, low), (hi, intervals, high)))

    holds = (lo <= hi) if closed else (lo < hi)
    # (no finer than the bounds' own precision, which keeps bin numbers small)
    length = F.greatest(b - a, F.abs(a) * 2.0 ** -50, F.abs(b) * 2.0 ** -50, F.lit(2.0 ** -1000))
    level = F.least(F.ceil(F.log2(length)), F.lit(_LAST_LEVEL)).cast("int")
    whole = F.struct(*map(_column, intervals.columns))
    binned = (intervals.filter(holds & ~F.isnan(a) & ~F.isnan(b))
              .select(whole.alias("__interval"), level.alias("__level"), a.alias("__a"), b.alias("__b")))
    spans = F.sequence(_bin(F.col("__a"), F.col("__level")), _bin(F.col("__b"), F.col("__level")))
    right = binned.select("__interval", F.col("__level").alias("__l"), F.explode(spans).alias("__b"))

    levels = sorted(r[0] for r in binned.select("__level").distinct().collect())
    if not levels:
        levels = [0]
    own = F.struct(*map(_column, points.columns))
    left = (points.filter(at.isNotNull() & ~F.isnan(x)).select(own.alias("__point"), x.alias("__x"))
            .withColumn("__level", F.explode(F.array(*map(F.lit, levels))))
            .withColumn("__bin", _bin(F.col("__x"), F.col("__level"))))
    p, i = F.col("__point"), F.col("__interval")
    inside = (i[low] <= p[value]) & ((p[value] <= i[high]) if closed else (p[value] < i[high]))
    met = left.join(right, (F.col("__level") == F.col("__l")) & (F.col("__bin") == F.col("__b")) & inside)
    return met.select(*(p.getField(c).alias(c) for c in points.columns),
                      *(i.getField(c).alias(c) for c in intervals.columns))
