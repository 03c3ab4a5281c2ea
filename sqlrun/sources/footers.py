"""What the files of a partition list are, found out in tasks.

``survey`` reads Parquet footers and sorts files by schema and depth: of every
file, or of one file for each leaf (``sample``).  ``unreadable`` only looks at
each file's last bytes, for scans that need no footer to be planned.  Both start
from the dataset's one listing (``FileIndex``), so no file is listed again; the
driver gets one row for each leaf and kind of file in it, which the spec bounds,
and file names only for leaves that hold more than one kind.

A file is unreadable if its own bytes say so: it is too short, doesn't end in
Parquet's mark, its footer's length doesn't fit, or the footer can't be parsed
from memory.  A failure to get at the bytes (a missing file, no permission)
says nothing about the file: it ends a survey that can't do without, and where
a scan can (``optional``), the file goes unseen and is left to Spark's reader,
which may know stores and credentials that tasks don't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .file_index import leaf_text_columns, list_files, with_leaves  # noqa: F401

# What a tail check says of a file that ends like Parquet, and of one in a
# store that tasks can't open by themselves.
WHOLE, UNSEEN = "whole", "unseen"


def _footer_reader(parse: bool = True, optional: bool = False):
    """The per-partition function shipped to executors: rows with a `path` get
    a `kind`, None for a file that is not Parquet, else a fingerprint of its
    schema (``WHOLE`` when footers aren't parsed).

    Built as a closure with its imports inside, so it is pickled by value:
    executors need pyarrow and pyspark, not this package on their path."""
    whole, unseen = WHOLE, UNSEEN

    def read_footers(batches: Iterator) -> Iterator:
        import hashlib
        import struct
        from urllib.parse import urlparse

        import pandas as pd
        import pyarrow as pa
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        def open_fs(path):
            u = urlparse(path)
            if u.scheme in ("", "file"):
                return pafs.LocalFileSystem(), path[len("file:"):] if u.scheme else path
            uri = path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1)
            return pafs.FileSystem.from_uri(uri)

        def footer(fh):
            """The footer's bytes (none of them if footers aren't parsed), or
            None for a file that doesn't end like Parquet."""
            size = fh.size()
            if size < 12:
                return None
            tail = fh.read_at(8, size - 8)
            length = struct.unpack("<I", tail[:4])[0]
            if tail[4:] not in (b"PAR1", b"PARE") or length == 0 or length > size - 12:
                return None
            return fh.read_at(length, size - 8 - length) + tail if parse else b""

        def kind(path):
            try:
                fs, local = open_fs(path)
                with fs.open_input_file(local) as fh:
                    data = footer(fh)
            except (pa.ArrowException, NotImplementedError, OSError):
                if not optional:
                    raise
                return unseen
            if data is None or not parse:
                return data if data is None else whole
            try:  # from memory: what fails now is the footer itself
                text = str(pq.ParquetFile(pa.BufferReader(b"PAR1" + data)).schema)
            except (pa.ArrowException, OSError):
                return None
            return hashlib.md5(text.split("\n", 1)[-1].encode()).hexdigest()  # without the object line

        for pdf in batches:
            # (what is known to be unreadable isn't opened again)
            known = pdf["kind"].isna() if "kind" in pdf else [False] * len(pdf)
            yield pdf.assign(kind=pd.Series([None if k else kind(p) for p, k in zip(pdf["path"], known)], pdf.index, object))

    return read_footers


@dataclass
class FileGroup:
    """Files of one schema below one list of deeper partition levels."""
    sample: str
    kind: str                                       # schema fingerprint, or UNSEEN
    first: tuple[int, ...]                          # list position of its first leaf
    deeper: str = ""
    paths: list[str] = field(default_factory=list)  # leaf folders, or files of a mixed leaf


@dataclass
class Survey:
    groups: list[FileGroup]            # in the order of their first leaves
    bad_leaves: list[dict[str, str]]   # escaped directory text per listed key
    bad_files: list[str]               # unreadable files in leaves that also hold readable ones


# Spark gives a task about 32 files of a listing, each of which counts as 4 MB;
# a Python task takes eight times as many, if that leaves every core some.
_LISTED_TASKS = 8


def _tasks(files: DataFrame) -> int:
    listed = files.select("path").rdd.getNumPartitions()
    return min(listed, max(2 * files.sparkSession.sparkContext.defaultParallelism, listed // _LISTED_TASKS))


def _checked(files: DataFrame, keys: list[str], parse: bool) -> DataFrame:
    """(path, kind, …) of the files, opened in tasks; their tails only, if
    tasks can, or their footers."""
    seen = files.select("path").coalesce(_tasks(files)).mapInPandas(
        _footer_reader(parse, optional=not parse), "path string, kind string")
    return with_leaves(seen.select("path", "kind", *leaf_text_columns("path", keys)), keys)


def _by_leaf(checked: DataFrame, keys: list[str]) -> DataFrame:
    dirs = [F.col(f"`_dir_{k}`") for k in keys]
    return checked.groupBy("leaf", *dirs, "deeper", "kind").agg(F.min("path").alias("path"))


def _within(files: DataFrame, leaves: list[str], how: str = "left_semi") -> DataFrame:
    """The files of some leaves (or, by `left_anti`, of all others)."""
    some = files.sparkSession.createDataFrame([(x,) for x in leaves], "some string")
    return files.join(F.broadcast(some), F.col("leaf") == F.col("some"), how)


def _sampled(files: DataFrame, keys: list[str], tails: bool) -> list:
    """As ``_by_leaf``, by the footer of one whole file for each leaf and depth;
    leaves in which a file is unreadable by all their footers."""
    seen = _checked(files, keys, parse=False) if tails else files.withColumn("kind", F.lit(WHOLE))
    leaves = _by_leaf(seen, keys).repartition(_tasks(files))
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in leaves.schema])
    rows = leaves.mapInPandas(_footer_reader(optional=True), nullable).collect()
    doubtful = sorted({r["leaf"] for r in rows if r["kind"] is None})
    if not doubtful:
        return rows
    known = set(doubtful)
    return [r for r in rows if r["leaf"] not in known] + _by_leaf(
        _checked(_within(files, doubtful), keys, parse=True), keys).collect()


def survey(spark: SparkSession, globs: list[str], keys: list[str], positions: list[dict[str, int]],
           files: DataFrame | None = None, sample: bool = False, tails: bool = True) -> Survey:
    """`positions` gives, for each key, the list position of a directory text;
    `files` is the listing (a new one of `globs` otherwise).  With `sample` one
    footer for each leaf is read (and, with `tails`, each file's last bytes)."""
    files = with_leaves(list_files(spark, globs, keys), keys) if files is None else files
    rows = _sampled(files, keys, tails) if sample else _by_leaf(_checked(files, keys, parse=True), keys).collect()
    kinds: dict[str, set] = {}
    for r in rows:
        kinds.setdefault(r["leaf"], set()).add(None if r["kind"] is None else (r["deeper"], r["kind"]))
    bad = [r for r in rows if r["kind"] is None]
    mixed = [x for x, own in kinds.items() if len(own - {None}) > 1]
    paths: dict[tuple, list[str]] = {}
    if mixed:  # only the files of these leaves are opened again
        for r in _checked(_within(files, mixed), keys, parse=not sample).filter(F.col("kind").isNotNull()).collect():
            paths.setdefault((r["leaf"], r["deeper"], None if sample else r["kind"]), []).append(r["path"])

    groups: dict[tuple, FileGroup] = {}
    end = len(max(positions, key=len)) if positions else 0
    order = lambda r: tuple(p.get(r[f"_dir_{k}"], end) for k, p in zip(keys, positions))
    for r in sorted((r for r in rows if r["kind"] is not None), key=lambda r: (order(r), r["path"])):
        group = groups.setdefault((r["deeper"], r["kind"]), FileGroup(r["path"], r["kind"], order(r), r["deeper"]))
        # (a sampled leaf of several depths: the files at this depth, of any kind)
        group.paths += paths.get((r["leaf"], r["deeper"], None if sample else r["kind"]), [r["leaf"]])
    return Survey(list(groups.values()),
                  [{k: r[f"_dir_{k}"] for k in keys} for r in bad if kinds[r["leaf"]] == {None}],
                  sorted(r["path"] for r in bad if kinds[r["leaf"]] != {None}))


@dataclass
class Tails:
    """Leaves without a whole file; unreadable files beside whole ones; and,
    where there is any of the former, the other leaves' folders."""
    bad_leaves: list[dict[str, str]]
    bad_files: list[str]
    good_leaves: list[str]


def unreadable(files: DataFrame, keys: list[str]) -> Tails:
    """Look at each file's last bytes."""
    dirs = [F.col(f"`_dir_{k}`") for k in keys]
    is_bad = F.col("kind").isNull()
    # One job sees every file; it returns leaves, and of those that hold only
    # whole files nothing but a count.
    leaves = (_checked(files, keys, parse=False).groupBy("leaf", *dirs)
              .agg(F.count(F.lit(1)).alias("n"), F.count_if(is_bad).alias("bad"),
                   F.min(F.when(is_bad, F.col("path"))).alias("path")))
    rows = leaves.filter("bad > 0").collect()
    bad = [r for r in rows if r["bad"] == r["n"]]
    mixed = sorted(r["path"] for r in rows if r["bad"] < r["n"])
    good: list[str] = []
    if bad and not mixed:
        good = sorted(r[0] for r in _within(files, [r["leaf"] for r in bad], "left_anti")
                      .select("leaf").distinct().collect())
    return Tails([{k: r[f"_dir_{k}"] for k in keys} for r in bad], mixed, good)
