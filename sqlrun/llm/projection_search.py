"""Largest inner products through low-dimensional stable projections.

With M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and a query
(q, 0): the squared distance is then |q|^2 + M^2 - 2 q.x, so the nearest are
those of the largest inner product.  A projection onto ``DIMENSIONS`` Gaussian
directions keeps distances up to a chi-square factor: projected over true
squared distance is chi-square with ``DIMENSIONS`` degrees of freedom.

All projected vectors are indexed by a kd-tree.  Its upper levels are split
planes at medians of a bounded sample (``SAMPLE_ROWS`` rows of least id hash);
they cut the space into cells, whose exact boxes are minima and maxima over
all rows.  A cell with more than ``CELL_ROWS`` rows, for instance copies of one
vector, is dealt into chunks.  Each chunk is a task's group with a kd-tree of
its own below.

A query takes projected neighbours in order of distance, leaf by leaf, and
verifies all of a leaf's by the inner product in double precision.  It stops when a
vector nearer than its k-th best would have been projected inside the radius
already searched with probability ``CERTAINTY`` (the chi-square test).  The
query's own cell comes first; the k-th best found there decides by the same
test which other cells it visits.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without an id or vectors of another
length than the most common (of equally common ones the longest); of rows with
one id the least vector counts; ties go to the smaller id; with fewer than k
candidates all are returned; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

DIMENSIONS = 16
CERTAINTY = 0.98
CELL_ROWS = 4096
MAX_CELLS = 1 << 14   # 2 x DIMENSIONS numbers each: what every task is sent
SAMPLE_ROWS = 20_000
LEAF_ROWS = 64


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square_m <= x) = p, for even m, by bisection."""
    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for j in range(1, m // 2):
            term *= x / 2 / j
            total += term
        return 1 - total
    lo, hi = 0.0, 20.0 * m
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


@dataclass(frozen=True)
class Projection:
    """Gaussian directions for vectors of `size` with an added coordinate."""
    size: int
    most: float  # the largest norm

    def directions(self) -> np.ndarray:
        """Gaussian; each coordinate's part is scaled to its expected length,
        so none (above all the added one) is stretched for all vectors alike."""
        g = np.random.default_rng(20240503).standard_normal((self.size + 1, DIMENSIONS))
        return g * (math.sqrt(DIMENSIONS) / np.linalg.norm(g, axis=1, keepdims=True))

    def data(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.most ** 2 - (x * x).sum(axis=1), 0))
        return np.concatenate((x, extra[:, None]), axis=1) @ self.directions()

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.directions()[:-1]


def split_planes(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and threshold of each inner node of a complete kd-tree (heap order)."""
    axes, cuts = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
    at = {1: points}
    for node in range(1, 1 << depth):
        own = at.pop(node, points[:0])
        if len(own):
            axes[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
            cuts[node] = np.median(own[:, axes[node]])
        left = own[:, axes[node]] <= cuts[node] if len(own) else np.empty(0, bool)
        at[2 * node], at[2 * node + 1] = own[left], own[~left]
    return axes, cuts


def cells_of(points: np.ndarray, planes: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    axes, cuts = planes
    node = np.ones(len(points), np.int64)
    rows = np.arange(len(points))
    for _ in range(depth):
        node = 2 * node + (points[rows, axes[node]] > cuts[node])
    return node - (1 << depth)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        x = points[:, k, None]
        out += np.maximum(np.maximum(low[None, :, k] - x, x - high[None, :, k]), 0) ** 2
    return out


class KdTree:
    """Leaves of at most LEAF_ROWS points, cut at medians of the widest axis."""

    def __init__(self, points: np.ndarray):
        parts, leaves = [np.arange(len(points))], []
        while parts:
            own = parts.pop()
            if len(own) <= LEAF_ROWS:
                leaves.append(own)
                continue
            axis = np.argmax(np.ptp(points[own], axis=0))
            order = own[np.argpartition(points[own, axis], len(own) // 2)]
            parts += [order[:len(own) // 2], order[len(own) // 2:]]
        self.leaves = leaves
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])


def search(ids: np.ndarray, x: np.ndarray, projection: Projection, query_ids: np.ndarray, q: np.ndarray,
           bounds: np.ndarray, k: int, certainty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of up to k rows for each query that are nearer
    than its bound (a squared distance).

    Each query takes its leaves in order of projected distance, in rounds of
    1, 2, 4, … leaves, as far as the test lets it; a round goes leaf by leaf
    over the queries that reach it.  Products of matrices choose candidates,
    whose scores are then summed in one order, whatever stands beside them."""
    points, at = projection.data(x), projection.queries(q)
    tree = KdTree(points)
    near = box_distance(at, tree.low, tree.high)
    factor = chi_square_quantile(certainty, DIMENSIONS)
    offset = (q * q).sum(axis=1) + projection.most ** 2
    slack = 1e-9 * (np.sqrt((q * q).sum(axis=1)) * projection.most + 1e-300)
    order = np.argsort(near, axis=1, kind="stable")
    reach = bounds.copy()                       # squared distance of the k-th best
    kth = (offset - bounds) / 2                 # its score; -inf without a bound
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))  # query, id, score
    done, step = 0, 1
    while done < len(tree.leaves):
        leaves = order[:, done:done + step]
        asked, column = np.nonzero(np.take_along_axis(near, leaves, axis=1) <= factor * reach[:, None])
        if not len(asked):
            break
        leaf = leaves[asked, column]
        sort = np.argsort(leaf, kind="stable")
        asked, leaf = asked[sort], leaf[sort]
        cuts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1], [True])))
        found = [best]
        for a, b in zip(cuts[:-1], cuts[1:]):
            own, rows = asked[a:b], tree.leaves[leaf[a]]
            hit = q[own] @ x[rows].T >= (kth[own] - slack[own])[:, None]
            r, c = np.nonzero(hit & (ids[rows][None, :] != query_ids[own][:, None]))
            if len(r):
                found.append((own[r], ids[rows[c]], (x[rows[c]] * q[own[r]]).sum(axis=1)))
        who, which, score = (np.concatenate(c) for c in zip(*found))
        sort = np.lexsort((which, -score, who))
        who, which, score = who[sort], which[sort], score[sort]
        start = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.empty(0, np.int64)
        rank = np.arange(len(who)) - np.repeat(start, np.diff(np.concatenate((start, [len(who)]))))
        last = rank == k - 1
        kth[who[last]] = np.maximum(kth[who[last]], score[last])
        reach = np.minimum(reach, np.maximum(offset - 2 * kth, 0))
        best = who[rank < k], which[rank < k], score[rank < k]
        done, step = done + step, step * 2
    return query_ids[best[0]], best[1], best[2]


def valid_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part; v holds doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (rows.select(F.col(key).cast("long").alias("id"), v.alias("v"))
            .filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite)
            .filter(F.exists("v", lambda c: c != 0))
            .groupBy("id").agg(F.min("v").alias("v")))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            certainty: float = CERTAINTY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of largest inner product
    found for each row where `is_query` (an expression of the column ``id``) holds."""
    spark = rows.sparkSession
    vectors = materialise(valid_vectors(rows, key, vector), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    sizes = vectors.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(norm).alias("most"))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    size, total = common["size"], common["n"]
    projection = Projection(size, common["most"])
    vectors = vectors.filter(F.size("v") == size)

    # The tree's upper levels: split planes from a bounded sample.
    cells = min(MAX_CELLS, max(1, -(-total // cell_rows)))
    depth = max(0, math.ceil(math.log2(cells)))
    sample = (vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toArrow() if depth else None)
    planes = split_planes(projection.data(_matrix(sample.column(0), size)), depth) if depth else (
        np.zeros(1, np.int64), np.zeros(1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), size)
                p, own = projection.data(x), projection.queries(x)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cells_of(p, planes, depth)), pa.array(cells_of(own, planes, depth)),
                     pa.array(list(p), pa.list_(pa.float64()))], ["id", "v", "cell", "home", "p"])

    placed = materialise(vectors.mapInArrow(
        place, "id long, v array<double>, cell long, home long, p array<double>"), "cells")
    ranges = [f(F.col("p")[d]).alias(f"{n}{d}") for n, f in (("lo", F.min), ("hi", F.max)) for d in range(DIMENSIONS)]
    # At most MAX_CELLS rows.
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *ranges).orderBy("cell").toArrow()
    cell_ids, counts = boxes.column("cell").to_numpy(), boxes.column("n").to_numpy()
    low = np.stack([boxes.column(f"lo{d}").to_numpy() for d in range(DIMENSIONS)], axis=1)
    high = np.stack([boxes.column(f"hi{d}").to_numpy() for d in range(DIMENSIONS)], axis=1)
    chunks = -(-counts // cell_rows)
    chunk_of = {int(c): int(n) for c, n in zip(cell_ids, chunks)}
    factor = chi_square_quantile(certainty, DIMENSIONS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to the chunks of their cells."""
        for batch in batches:
            cell, ids = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            many = np.array([chunk_of[int(c)] for c in cell], np.int64)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(mixed % np.maximum(many, 1)), batch.column(0),
                                              batch.column(2)], ["cell", "chunk", "id", "v"])

    def route(batches: Iterator[pa.RecordBatch], home: bool) -> Iterator[pa.RecordBatch]:
        """Queries (id, v, home, bound) to the chunks they visit."""
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1), size)
            near = box_distance(projection.queries(q), low, high)
            bound = batch.column(3).to_numpy(zero_copy_only=False)
            # The cell that a query falls into may be empty: its nearest box is its home.
            own = np.argmin(near, axis=1)
            visit = np.zeros(near.shape, bool)
            if home:
                visit[np.arange(len(q)), own] = True
            else:
                visit = near <= factor * bound[:, None]
                visit[np.arange(len(q)), own] = False
            row, box = np.nonzero(visit)
            times = chunks[box]
            row, box = np.repeat(row, times), np.repeat(box, times)
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell_ids[box]), pa.array(chunk), batch.column(0).take(pa.array(row)),
                 batch.column(1).take(pa.array(row)), pa.array(bound[row])], ["cell", "chunk", "id", "v", "bound"])

    def verify(key_values, data: pa.Table, asked: pa.Table) -> pa.Table:
        if not (data.num_rows and asked.num_rows):
            return found_schema.empty_table()
        return pa.table(list(search(
            data.column("id").to_numpy(), _matrix(data.column("v"), size), projection, asked.column("id").to_numpy(),
            _matrix(asked.column("v"), size), asked.column("bound").to_numpy(), k, certainty)), schema=found_schema)

    found_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    visit_ddl = "cell long, chunk long, id long, v array<double>, bound double"
    dealt = placed.select("id", "cell", "v").mapInArrow(deal, "cell long, chunk long, id long, v array<double>")

    def answers(visits: DataFrame) -> DataFrame:
        # mapInArrow wraps the function's own partitioning; groups meet by (cell, chunk).
        return dealt.groupBy("cell", "chunk").cogroup(visits.groupBy("cell", "chunk")).applyInArrow(
            verify, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asked = placed.filter(is_query).select("id", "v", "home", F.lit(float("inf")).alias("bound"))
    first = materialise(answers(asked.mapInArrow(lambda b: route(b, True), visit_ddl)), "home-answers")
    # What the home cell gave bounds the distance of the k-th best.
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    kth = (first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
           .select(F.col("query_id").alias("of"), F.col("score").alias("kth")))
    bounded = asked.join(kth, F.col("id") == F.col("of"), "left").select(
        "id", "v", "home", F.coalesce(F.greatest(norm2 + projection.most ** 2 - 2 * F.col("kth"), F.lit(0.0)),
                                      F.lit(float("inf"))).alias("bound"))
    others = answers(bounded.mapInArrow(lambda b: route(b, False), visit_ddl))
    return (first.unionByName(others).withColumn("rank", F.row_number().over(best).cast("int"))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
