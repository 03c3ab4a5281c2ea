"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Hang the neighbours of each node (the larger, or the node itself and
    its smaller ones) on the least of them and the node."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("m", "u").alias("m"))
    joined = pairs.join(least, F.col("u") == F.col("of"))
    if larger:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("of").alias("u"), F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`edges` (u, v) -> (u, root): every node that has an edge, with the least
    node of its component.  Alternates large and small stars, which takes
    about log2 of the longest path rounds; each round is written to the shared
    folder.  Nodes are joined on, never gathered, so a component of any size
    is spread over all tasks."""
    now = materialise(edges.filter(F.col("u") != F.col("v"))
                      .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    size = _print_of(now)
    while True:
        now = materialise(_star(_both_ways(now), True), "large-star")
        now = materialise(_star(now, False), "small-star")
        before, size = size, _print_of(now)
        if size == before:
            break
    roots = now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return now.select("u", F.col("v").alias("root")).unionByName(roots)


def _print_of(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
