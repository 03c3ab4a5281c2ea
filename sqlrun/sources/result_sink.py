"""Result sink: Parquet under a run id, read-back in order, bounded preview,
file manifest.

A sorted result is written range by range: part files follow each other by the
ordinal in their names (and the counter of files that one task wrote), rows by
their place within the file.  Reading such a folder gives its rows in any
order, so what depends on it - a preview, a read-back that keeps the order -
goes by these places (``_metadata``), not by chance.
"""

from __future__ import annotations

import logging
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


log = logging.getLogger("sqlrun")


class SinkError(ValueError):
    pass


def output_path(prefix: str, run_id: str | None = None) -> str:
    if not prefix or not prefix.strip():
        raise SinkError("output prefix cannot be empty")
    # "." and ".." would name the prefix and its parent, which a write replaces.
    if run_id is not None and (run_id.strip() in ("", ".", "..") or "/" in run_id):
        raise SinkError(f"run id {run_id!r} must be a non-blank name without '/', other than '.' and '..'")
    return prefix.rstrip("/") + "/" + (run_id or str(uuid.uuid4()))


def write_result(df: DataFrame, prefix: str, run_id: str | None = None) -> str:
    """Write ``df`` as Parquet to ``prefix/run_id`` (overwrite) and return the
    path.  Duplicate column names are rejected before any job starts.  The
    write is distributed: each task writes its own files, and a sorted result
    keeps its order across the part files (range-partitioned sort)."""
    names = [c.lower() for c in df.columns]
    dups = sorted({c for c in names if names.count(c) > 1})
    if dups:
        raise SinkError(f"result has duplicate column names: {dups}")
    path = output_path(prefix, run_id)
    df.write.mode("overwrite").parquet(path)
    log.info("result written to %s", path)
    return path


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """A written result, its rows in no particular order."""
    try:
        return spark.read.parquet(path)
    except Exception as exc:
        if "UNABLE_TO_INFER_SCHEMA" in str(exc) or "PATH_NOT_FOUND" in str(exc):
            raise SinkError(f"no Parquet files at {path}") from exc
        raise


# How Spark names the files of a write, by task and by the
# task's count of files.
_PART, _COUNT = r"part-(\d+)", r"-c(\d+)\."
# Table of files that is broadcast to rank rows (a row is under 200 bytes).
BROADCAST_FILES = 100_000


def _place(name: Column) -> list[Column]:
    number = lambda pattern: F.coalesce(
        F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("bigint"), F.lit(0))
    return [number(_PART).alias("part"), number(_COUNT).alias("count"), name.alias("file")]


def _file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


_ROW = "__sqlrun_row"


def _columns(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def _new_name(df: DataFrame, rank: str) -> str:
    if rank.lower() in (c.lower() for c in df.columns):
        raise SinkError(f"the result has a column {rank!r} already")
    return rank


def _with_place(df: DataFrame) -> DataFrame:
    """`df`, read from Parquet, with each row's file and place in one struct."""
    return df.withColumn(_ROW, F.struct(*_place(F.col("_metadata.file_name")),
                                        F.col("_metadata.row_index").alias("row")))


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """A written result in the order it was written in: one range-partitioned
    sort by file and row."""
    df = read_result(spark, path)
    return _with_place(df).orderBy(_ROW).select(*_columns(df))


def read_ranked(spark: SparkSession, path: str, rank: str = "rank") -> DataFrame:
    """A written result with each row's place in it, from 1, as `rank`.

    Rows are counted by file (footers only), the counts summed up in the files'
    order, and a row's rank is its file's sum plus its place in the file: rows
    are neither sorted nor shuffled."""
    df = read_result(spark, path)
    rank = _new_name(df, rank)
    counts = (_with_place(df).groupBy(F.col(_ROW)["part"].alias("part"), F.col(_ROW)["count"].alias("count"),
                                      F.col(_ROW)["file"].alias("file")).agg(F.count(F.lit(1)).alias("rows")))
    before = Window.orderBy("part", "count", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))  # a row a file
    if manifest(spark, path).count() <= BROADCAST_FILES:
        bases = F.broadcast(bases)
    return (_with_place(df).join(bases, F.col(_ROW)["file"] == F.col("file"))
            .select(*_columns(df), (F.col("base") + F.col(_ROW)["row"] + 1).alias(rank)))


def preview(spark: SparkSession, path: str, n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of a written result, in its order (numbered from 1
    by `rank`, if given).  Only the first files are read: as many as hold
    ``n`` rows, found by counting them a few at a time."""
    if n < 0:
        raise SinkError("preview size must be >= 0")
    df = read_result(spark, path)
    rank = rank if rank is None else _new_name(df, rank)
    files = manifest(spark, path).select("path", *_place(_file_name(F.col("path"))))
    taken: list[str] = []
    found, step = 0, 1
    while found < n:
        more = [r["path"] for r in files.orderBy("part", "count", "file").offset(len(taken)).limit(step).collect()]
        if not more:
            break
        found += _read_files(spark, df, more).count()
        taken += more
        step *= 4
    first = _with_place(_read_files(spark, df, taken) if taken else df).orderBy(_ROW).limit(n)
    if rank is None:
        return first.select(*_columns(df))
    number = F.row_number().over(Window.orderBy(_ROW)).cast("bigint")  # of n rows
    return first.select(*_columns(df), _ROW, number.alias(rank)).orderBy(_ROW).drop(_ROW)


def _read_files(spark: SparkSession, df: DataFrame, paths: list[str]) -> DataFrame:
    return spark.read.schema(df.schema).parquet(*map(unquote, paths))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per-file listing of a result (path, bytes), computed by a Spark
    listing of the Parquet parts with their content pruned."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
            .load(path).select(F.col("path"), F.col("length").alias("bytes")))


def manifest_summary(spark: SparkSession, path: str) -> DataFrame:
    return manifest(spark, path).agg(F.count(F.lit(1)).alias("files"),
                                     F.sum("bytes").cast("bigint").alias("bytes"))
