"""Mixing sources to target weights by hash-threshold histograms.

A source's target is its share of all words; shares follow weights, and a
source is repeated at most ``max_repeats`` times.  What one source can't take
is shared out among the others by weight: with the sources in the order of
``cap / weight``, the shared level is the first that no later source caps, so
a window over the (small) table of sources finds it.

A target of ``r`` times a source's size takes every document ``floor(r)``
times and, once more, those whose 36-bit hash lies under a threshold.  The
threshold comes from nested histograms: words by source and the hash's first
12 bits, a running sum over at most 4,096 buckets to the one where the budget
is crossed, and again with the next 12 bits for the documents in that bucket
alone.  Documents are then filtered by comparing their hash, so nothing is
sorted, and only sums per (source, bucket) are shuffled: a source with a third
of all rows is pre-aggregated on the map side like any other.

Defined results:
- a null text has size 0 and is taken like its source's other documents; null
  sources form one source, last in order;
- rows equal in id and text share one hash, hence one fate;
- a source of size 0 has target 0, and its documents are taken 0 times;
- an empty table gives an empty result;
- other columns are kept; the result is one struct column under a name that
  no column of the input has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, materialise, sealed

BITS = 12           # hash bits that one histogram resolves
LEVELS = 3          # nested histograms
# Largest source table that is broadcast (a row is under 100 bytes).
BROADCAST_SOURCES = 100_000


def mix_hash(*columns: Column) -> Column:
    """36-bit hash of the columns' texts, a long."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0,
                   max_repeats: int = 3) -> DataFrame:
    """(source, source_size) -> with target: double.  Weights go round by the
    sources' code-point order, nulls last."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    return (sizes
            .withColumn("k", F.row_number().over(by_name) - 1)
            .withColumn("weight", weight.cast("long"))
            .withColumn("cap", F.col("source_size") * max_repeats)
            .withColumn("ratio", F.col("cap") / F.col("weight"))
            .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
            # the first source whose cap is not under the level of what is left
            .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level")))
                        .over(everything)["level"])
            .withColumn("target", F.least(F.col("cap").cast("double"),
                                          F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
            .select("source", "source_size", "target"))


def _refine(state: DataFrame, sized: DataFrame, level: int) -> DataFrame:
    """Narrow each source's boundary by one histogram: `state` has (source,
    prefix, need, inner), and prefix grows by the bucket in which the running
    sum reaches `need`."""
    shift = BITS * (LEVELS - 1 - level)
    here = F.shiftright(F.col("h"), shift)
    rows = sized.join(state.select(F.col("source").alias("s"), "prefix", "need"),
                      F.col("source").eqNullSafe(F.col("s")))
    if level:
        rows = rows.filter(F.shiftright(F.col("h"), shift + BITS) == F.col("prefix"))
    running = Window.partitionBy("source").orderBy("bucket")
    crossed = (rows.groupBy("source", "need", here.alias("bucket")).agg(F.sum("size").alias("words"))
               .withColumn("sum", F.sum("words").over(running))
               .filter(F.col("sum") >= F.col("need"))
               .groupBy("source", "need").agg(F.min(F.struct("bucket", "words", "sum")).alias("b")))
    return crossed.select("source", F.col("b.bucket").alias("prefix"),
                          (F.col("need") - (F.col("b.sum") - F.col("b.words"))).alias("need"),
                          F.col("b.words").alias("inner"))


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0,
             max_repeats: int = 3) -> DataFrame:
    """(source, size, h) rows -> one row per source: source_size, target, the
    whole copies of each document, and the hash under which there is one more."""
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")),
                             weights, share, max_repeats)
    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats)).cast("long")
    sources = materialise(
        sources.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")
    small = sources.count() <= BROADCAST_SOURCES
    hinted = F.broadcast if small else (lambda df: df)

    state = sources.select("source", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("need"))
    for level in range(LEVELS):
        state = materialise(_refine(hinted(state), sized, level), "mix-boundary")
    # What is left is one last bucket: in, if that brings the sum nearer.
    cut = F.col("prefix") + F.when(F.col("need") * 2 >= F.col("inner"), F.lit(1)).otherwise(F.lit(0))
    cut = F.when(F.col("whole") >= max_repeats, F.lit(0)).otherwise(cut)
    cuts = state.select(F.col("source").alias("s"), "prefix", "need", "inner")
    return hinted(sources.join(hinted(cuts), F.col("source").eqNullSafe(F.col("s")), "left")
                  .select("source", "source_size", "target", "whole",
                          F.coalesce(cut, F.lit(0)).cast("long").alias("cut")))


def mix_sources(docs: DataFrame, size: Column, key: Column, source: str = "source",
                weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """`docs` with one more column ``mix``: struct(size, source_size, target,
    copies), copies being how often the mix takes the document.  `key` is the
    36-bit hash (``mix_hash``) that decides which documents are taken."""
    name = fresh_name(docs.columns, "mix")
    sized = docs.select(F.col(source).alias("source"), size.alias("size"), key.alias("h"))
    plan = mix_plan(sized, weights, share, max_repeats).select(
        F.col("source").alias("of"), "source_size", "target", "whole", "cut")
    rows = docs.select(sealed(docs).alias("row"), F.col(source).alias("own"), size.alias("size"), key.alias("h"))
    copies = F.col("whole") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)
    return (rows.join(plan, F.col("own").eqNullSafe(F.col("of")), "left")
            .select(*(F.col("row").getField(c).alias(c) for c in docs.columns),
                    F.struct("size", "source_size", "target", copies.cast("long").alias("copies")).alias(name)))
