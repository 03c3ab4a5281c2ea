"""One listing of the files below a partition list.

``FileIndex`` lists a dataset's globs once, in Spark (a ``binaryFile`` read with
the content pruned: no file body is opened), and everything that needs to know
what lies there is derived from that listing: which roots a glob in the base
path stands for, the first leaf, the footer survey, the tail checks and the
coverage.  The listing itself stays in Spark; the driver gets rows for leaves,
which the spec bounds, never for files.
"""

from __future__ import annotations

import re
import threading
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import DatasetSpec
from .hive_paths import brace_glob, directory_texts, hive_escape, leaf_globs


def is_path_not_found(exc: Exception) -> bool:
    text = str(exc)
    return "PATH_NOT_FOUND" in text or "Path does not exist" in text


def _leaf_pattern(keys: list[str]) -> str:
    """Groups: the root, the leaf's folders below it, what lies below the leaf."""
    folders = "/".join(re.escape(hive_escape(k)) + "=[^/]*" for k in keys)
    return f"^(.*)/({folders})/(.*)$"


def leaf_text_columns(path_col: str, keys: list[str]) -> list:
    """Escaped directory text of each listed key, cut out of a file path."""
    cols = []
    for k in keys:
        pattern = ".*/" + re.escape(hive_escape(k)) + "=([^/]*)/"
        cols.append(F.regexp_extract(F.col(path_col), pattern, 1).alias(f"_dir_{k}"))
    return cols


def list_files(spark: SparkSession, globs: list[str], keys: list[str]) -> DataFrame:
    """(path, length, one directory text per key) of every file below what the
    globs match.  A recursive lookup infers no partition columns, so leaves may
    differ in depth."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(globs))
            .select("path", "length", *leaf_text_columns("path", keys)))


def with_leaves(files: DataFrame, keys: list[str]) -> DataFrame:
    """`files` (path, ...) with the root, the leaf's path, and the keys of the
    partition levels below it."""
    pattern = _leaf_pattern(keys)
    below = F.regexp_replace(F.regexp_extract("path", pattern, 3), "[^/]*$", "")
    root, leaf = (F.regexp_extract("path", pattern, k) for k in (1, 2))
    return files.select("*", root.alias("root"), F.concat(root, F.lit("/"), leaf).alias("leaf"),
                        F.regexp_replace(below, "=[^/]*/", "/").alias("deeper"))


class FileIndex:
    """The files of a partition-listed dataset, listed once."""

    def __init__(self, spark: SparkSession, ds: DatasetSpec, files: DataFrame | None = None) -> None:
        self.spark, self.dataset = spark, ds
        self.keys = [p.key for p in ds.partitions]
        self.files = with_leaves(self._listed(), self.keys) if files is None else files

    def _listed(self) -> DataFrame:
        try:
            return list_files(self.spark, leaf_globs(self.dataset), self.keys)
        except AnalysisException as exc:
            if not is_path_not_found(exc):
                raise
            # Spark refuses a glob that matches nothing; one glob over all
            # values takes what exists, and lists the base folder for it.
            return list_files(self.spark, [brace_glob(self.dataset)], self.keys)

    def positions(self) -> list[dict[str, int]]:
        """For each key, the list position of a directory text."""
        out = []
        for p in self.dataset.partitions:
            own: dict[str, int] = {}
            for k, v in enumerate(p.values):
                for text in directory_texts(v):
                    own.setdefault(text, k)
            out.append(own)
        return out

    def roots(self) -> list[str]:
        """What the base path stands for, as far as it holds a listed leaf."""
        return sorted(r[0] for r in self.files.select("root").distinct().collect())

    def below(self, root: str) -> FileIndex:
        """The same listing, of one root."""
        return FileIndex(self.spark, replace(self.dataset, path=root), self.files.filter(F.col("root") == root))

    def first_file(self) -> tuple[str, str] | None:
        """Leaf folder and path of a file in the first leaf, in list order,
        that holds one."""
        files, rank = self.files, []
        for k, (key, own) in enumerate(zip(self.keys, self.positions())):
            # Each key's values in list order, as a small table to look up.
            place = self.spark.createDataFrame(list(own.items()), f"_t{k} string, _n{k} int")
            files = files.join(place, F.col(f"`_dir_{key}`") == F.col(f"_t{k}"))
            rank.append(F.col(f"_n{k}"))
        first = files.agg(F.min(F.struct(*rank, "path", "leaf")).alias("first")).first()["first"]
        return None if first is None else (first["leaf"], first["path"])

    def per_leaf(self) -> DataFrame:
        """Files and bytes by the listed keys' directory texts."""
        return (self.files.groupBy(*[F.col(f"`_dir_{k}`") for k in self.keys])
                .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")))


class LazyIndex:
    """A dataset's index, listed when it is first asked for."""

    def __init__(self, spark: SparkSession, ds: DatasetSpec) -> None:
        self._make = lambda: FileIndex(spark, ds)
        self._lock, self._index = threading.Lock(), None

    @classmethod
    def of(cls, index: FileIndex) -> LazyIndex:
        out = cls(index.spark, index.dataset)
        out._index = index
        return out

    def __call__(self) -> FileIndex:
        with self._lock:
            if self._index is None:
                self._index = self._make()
            return self._index
