"""Partition-list Parquet scan: the core source.

A dataset names a base path and, per partition level, the values wanted.  The
whole Cartesian product of values is read by **one** Parquet scan over brace
globs, one per first-level value (``base/k1=a/{k2=x,k2=y}``):

* one distributed folder listing (two only when Spark's inferred partition
  types cannot be cast back exactly to the listed ones) instead of one
  driver-side read and footer probe per leaf, and a flat plan instead of a
  union as deep as the leaf count; the partition root itself is never listed;
* leaves that do not exist match nothing and are simply absent;
* Catalyst sees a single ``FileScan`` with the partition columns, so filters
  on them prune files (``PartitionFilters``), data filters reach the reader
  (``PushedFilters``) and only the selected columns are read (``ReadSchema``).

Listed partition columns get the type of the listed values (or a declared
type), not Spark's inferred one, so ``'08'`` or ``'2024-01-01'`` stay text.
Data-column schemas are merged across files.  Where one scan can't hold all
leaves (types that Spark's merge rejects, leaves of different depth, files that
are not Parquet) a distributed footer survey sorts the files by schema and
depth; each kind is one scan, and the scans are joined by ``unionByName``, which
widens types and adds missing columns as a union of the leaves would.  A leaf
without a readable file is left out and reported in the coverage; a leaf with
readable and unreadable files is an error that names them, never a silent loss.
With a declared schema, or ``schema_mode: first``, footers are not read; the last
bytes of each file are, in tasks, so that the same leaves are left out
(``check_files: false`` spares that: then an unreadable file fails the run).
``schema_mode: leaf`` reads one footer for each leaf instead of every file's.

The files are listed once for all that is asked about them (``FileIndex``).  A
base path that is a glob stands for every root that holds a listed leaf: each is
one scan as above, and the scans are joined by name.
"""

from __future__ import annotations

import logging
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import DatasetSpec
from ..operators.multiplicity import apply_multiplicity
from . import footers
from .file_index import LazyIndex, is_path_not_found
from .hive_paths import brace_glob, column_type, leaf_globs, leaf_path


log = logging.getLogger("sqlrun.scan")


class ScanError(ValueError):
    """No data could be loaded for a dataset."""


class NoReadableLeaf(ScanError):
    """Whatever exists of the listed leaves is unreadable."""

    def __init__(self, message: str, bad_leaves: list[dict[str, str]] = ()) -> None:
        super().__init__(message)
        self.bad_leaves = list(bad_leaves)


@dataclass
class Scan:
    spark: SparkSession
    dataset: DatasetSpec
    df: DataFrame                      # rows with multiplicity applied
    leaf_df: DataFrame | None          # one copy per distinct leaf (for counts)
    globs: list[str]
    bad_leaves: list[dict[str, str]] = field(default_factory=list)
    index: LazyIndex | None = None     # the one listing of a partition list

    def coverage(self, with_rows: bool = True) -> DataFrame:
        from ..operators.coverage import coverage_frame

        return coverage_frame(self, with_rows=with_rows)


def scan_dataset(spark: SparkSession, ds: DatasetSpec | dict) -> Scan:
    """Read one dataset: a plain path, or the listed partitions of a Hive
    layout (see the module docstring).  ``ds`` may be a dataset dict."""
    if not isinstance(ds, DatasetSpec):
        ds = DatasetSpec.from_dict(ds)
    if not ds.partitions:
        return _scan_flat(spark, ds)
    return _scan_listed(spark, ds)


# --------------------------------------------------------------------- flat
def _scan_flat(spark: SparkSession, ds: DatasetSpec) -> Scan:
    reader = spark.read
    if ds.schema:
        reader = reader.schema(ds.schema)
    elif ds.merge_schema:
        reader = reader.option("mergeSchema", "true")
    try:
        df = reader.parquet(ds.base_path)
    except Exception as exc:
        if not isinstance(exc, AnalysisException) and not _is_recoverable(exc):
            raise
        raise ScanError(f"No data loaded for dataset '{ds.name}' from {ds.base_path}: "
                        f"{_first_line(exc)}") from exc
    return Scan(spark, ds, df, df, [ds.base_path])


# ------------------------------------------------------------------- listed
def _scan_listed(spark: SparkSession, ds: DatasetSpec) -> Scan:
    index = LazyIndex(spark, ds)
    df, globs, bad = _scan_roots(spark, ds, index) if ds.has_many_roots else _scan_root(spark, ds, index)
    log.info("dataset %s: %d listed partition(s) under %s, %d glob(s)",
             ds.name, ds.leaf_count, ds.base_path, len(globs))
    if bad:
        log.warning("dataset %s: %d partition(s) hold no readable file and were skipped",
                    ds.name, len(bad))
    return Scan(spark, ds, apply_multiplicity(df, ds), df, globs, bad, index)


Found = tuple[DataFrame, list[str], list[dict[str, str]]]   # rows, globs, unreadable leaves


def _scan_root(spark: SparkSession, ds: DatasetSpec, index: LazyIndex) -> Found:
    """The listed leaves below one root folder."""
    pool = ThreadPoolExecutor(max_workers=1)
    # Modes that open no footer, or few, look at the files' tails meanwhile.
    tails = pool.submit(lambda: footers.unreadable(index().files, index().keys)) \
        if ds.check_files and (ds.schema or ds.schema_mode == "first") else None
    globs = leaf_globs(ds)
    try:
        try:
            df, bad = _read_listed(spark, ds, globs, index, tails)
        except AnalysisException as exc:
            # Spark refuses a glob that matches nothing.  One glob over all values
            # lists the base folder once and takes what exists.
            if not is_path_not_found(exc):
                raise
            globs = [brace_glob(ds)]
            df, bad = _read_listed(spark, ds, globs, index, tails)
    except AnalysisException as exc:
        if not is_path_not_found(exc):
            raise
        raise ScanError(f"No data loaded for dataset '{ds.name}'. All {ds.leaf_count} listed "
                        f"partition(s) are missing under {ds.base_path}") from exc
    finally:
        pool.shutdown(wait=False)
    return df, globs, bad


def _scan_roots(spark: SparkSession, ds: DatasetSpec, index: LazyIndex) -> Found:
    """A base path that is a glob: its listing names the roots that hold a
    listed leaf; each root is scanned like a base path of its own, and the scans
    are joined by name in the roots' order."""
    try:
        roots = index().roots()
    except AnalysisException as exc:
        if not is_path_not_found(exc):
            raise
        roots = []
    if not roots:
        raise ScanError(f"No data loaded for dataset '{ds.name}'. All {ds.leaf_count} listed "
                        f"partition(s) are missing under {ds.base_path}")

    def one(root: str) -> Found:
        own = index().below(root)
        try:
            return _scan_root(spark, own.dataset, LazyIndex.of(own))
        except NoReadableLeaf as exc:
            return None, [], exc.bad_leaves

    with ThreadPoolExecutor(max_workers=min(8, len(roots))) as pool:
        found = list(pool.map(one, roots))
    frames = [df for df, _, _ in found if df is not None]
    lost = [(root, leaf) for root, (_, _, bad) in zip(roots, found) for leaf in bad]
    if not frames:
        raise ScanError(f"No data loaded for dataset '{ds.name}': every listed partition is missing or unreadable")
    if lost:
        # A leaf is its folders below all roots: unreadable here, whole there
        # is an error, as within one folder.
        dirs = [f"_dir_{p.key}" for p in ds.partitions]
        of = {tuple(leaf[p.key] for p in ds.partitions): root for root, leaf in lost}
        bad_at = spark.createDataFrame(sorted((root, *(leaf[p.key] for p in ds.partitions)) for root, leaf in lost),
                                       T.StructType([T.StructField(c, T.StringType()) for c in ("root", *dirs)]))
        held = index().files.select("root", *[F.col(f"`{c}`") for c in dirs]).distinct()
        both = (held.join(F.broadcast(bad_at.select(*[F.col(f"`{c}`") for c in dirs]).distinct()), dirs, "left_semi")
                .join(F.broadcast(bad_at), ["root", *dirs], "left_anti").limit(5).collect())
        if both:
            shown = ", ".join(of[tuple(r[c] for c in dirs)] for r in both)
            raise ScanError(f"dataset '{ds.name}': partitions that are readable below one root are "
                            f"unreadable below another, such as {shown}")
    return _union(frames), [g for _, globs, _ in found for g in globs], [leaf for leaf in {
        tuple(leaf.items()): leaf for _, leaf in lost}.values()]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def _read_listed(spark: SparkSession, ds: DatasetSpec, globs: list[str], index: LazyIndex,
                 tails: Future | None = None) -> tuple[DataFrame, list[dict[str, str]]]:
    listed = {p.key: column_type(p) for p in ds.partitions}
    if ds.schema:
        try:
            declared = T.StructType.fromDDL(ds.schema)
        except Exception as exc:
            raise ScanError(f"dataset '{ds.name}': schema must be a DDL column list "
                            f"('a INT, b STRING'): {exc}") from exc
        try:
            df = _read_typed(spark, ds, globs, declared, listed)
        except Exception as exc:  # leaves of different depth
            if is_path_not_found(exc) or not _is_recoverable(exc):
                raise
            return _read_groups(spark, ds, index, listed, exc, declared)
        good, bad = _whole_leaves(ds, tails)
        return (_read_typed(spark, ds, good, declared, listed) if bad else df), bad
    if ds.schema_mode == "leaf":
        return _read_sampled(spark, ds, globs, index, listed)
    bad, early = [], None
    if tails is not None:  # by one footer, planned while files are looked at
        try:
            early = _infer(spark, ds, globs, merge=False)
        except Exception as exc:  # perhaps that of a file that isn't read in the end
            if is_path_not_found(exc) or not (isinstance(exc, ScanError) or _is_recoverable(exc)):
                raise
        good, bad = _whole_leaves(ds, tails)
        if bad:
            globs, early = good, None
    # The first listed leaf's own schema (for union column order) and the
    # merged schema are independent reads: run them together.
    with ThreadPoolExecutor(max_workers=1) as pool:
        first = pool.submit(_first_leaf_schema, spark, ds, index) if ds.merge_schema else None
        try:
            inferred_df = early or _infer(spark, ds, globs, merge=ds.merge_schema)
            inferred = inferred_df.schema
        except Exception as exc:  # merge conflict or unreadable footer (job failure)
            if is_path_not_found(exc) or not _is_recoverable(exc):
                raise
            return _read_groups(spark, ds, index, listed, exc)
        first_schema = first.result() if first is not None else None
    schema = _with_partition_types(inferred, listed, append_missing=True)
    if first_schema is not None:
        schema = _union_order(first_schema, schema, listed)
    if _casts_back(ds, inferred, listed):
        # Reuse the inference read (one listing): its partition columns
        # carry Spark's inferred types, which were just shown to convert to
        # the listed types exactly for every listed value.
        return _in_order(inferred_df.select(*_retyped(inferred, listed)), schema), bad
    return _in_order(spark.read.schema(schema).option("basePath", ds.base_path).parquet(*globs), schema), bad


def _whole_leaves(ds: DatasetSpec, tails: Future | None) -> tuple[list[str], list[dict[str, str]]]:
    """Leaf folders to read and the unreadable leaves, by the files' tails;
    nothing to leave out where files aren't looked at."""
    if tails is None:
        return [], []
    seen = tails.result()
    if seen.bad_files:
        raise _damaged(ds, seen.bad_files)
    if seen.bad_leaves and not seen.good_leaves:
        raise _nothing_readable(ds, seen.bad_leaves)
    return seen.good_leaves, seen.bad_leaves


def _damaged(ds: DatasetSpec, files: list[str]) -> ScanError:
    return ScanError(f"dataset '{ds.name}': {len(files)} unreadable file(s) beside readable "
                     f"ones, such as {', '.join(files[:5])}")


def _nothing_readable(ds: DatasetSpec, bad_leaves: list[dict[str, str]]) -> NoReadableLeaf:
    return NoReadableLeaf(f"No data loaded for dataset '{ds.name}': every listed "
                          f"partition is missing or unreadable", bad_leaves)


def _in_order(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Spark moves a partition column that is also a file column to the end
    and appends partition levels found below the listed ones; put the columns
    back in schema order (deeper levels last)."""
    order = [f.name for f in schema.fields]
    order += [c for c in raw.columns if c not in set(order)]
    return raw.select(*[F.col(f"`{c}`") for c in order])


def _read_typed(spark: SparkSession, ds: DatasetSpec, paths: list[str], data: T.StructType,
                listed: dict[str, T.DataType]) -> DataFrame:
    schema = _with_partition_types(data, listed, append_missing=True)
    return _in_order(spark.read.schema(schema).option("basePath", ds.base_path).parquet(*paths), schema)


def _surveyed(spark: SparkSession, ds: DatasetSpec, index: LazyIndex, sample: bool = False) -> footers.Survey:
    found = footers.survey(spark, [], index().keys, index().positions(), files=index().files,
                           sample=sample, tails=ds.check_files)
    if found.bad_files:
        raise _damaged(ds, found.bad_files)
    if not found.groups:
        raise _nothing_readable(ds, found.bad_leaves)
    return found


def _read_groups(spark: SparkSession, ds: DatasetSpec, index: LazyIndex, listed: dict[str, T.DataType],
                 cause: Exception, declared: T.StructType | None = None) -> tuple[DataFrame, list[dict[str, str]]]:
    """One scan for each schema and depth, joined as a by-name union of the
    leaves in list order."""
    try:
        found = _surveyed(spark, ds, index)
    except ScanError as exc:
        raise exc from cause
    schemas = [declared or spark.read.parquet(group.sample).schema for group in found.groups]
    return _read_each(spark, ds, found.groups, schemas, listed), found.bad_leaves


def _read_each(spark: SparkSession, ds: DatasetSpec, groups: list[footers.FileGroup],
               schemas: list[T.StructType], listed: dict[str, T.DataType]) -> DataFrame:
    frames = []
    for group, data in zip(groups, schemas):
        df = _read_typed(spark, ds, group.paths, data, listed)
        # As in a leaf: file columns (a key that is one stays in place), deeper
        # levels, then the listed keys.
        lower = {f.name.lower() for f in data.fields}
        keys = [k for k in listed if k.lower() not in lower]
        own = [c for c in df.columns if c.lower() in lower]
        deeper = [c for c in df.columns if c not in own and c not in keys]
        frames.append(df.select(*[F.col(f"`{c}`") for c in own + deeper + keys]))
    return _union(frames)


def _read_sampled(spark: SparkSession, ds: DatasetSpec, globs: list[str], index: LazyIndex,
                  listed: dict[str, T.DataType]) -> tuple[DataFrame, list[dict[str, str]]]:
    """The schema of one file for each leaf: one scan where Parquet's reader
    widens all of them to one schema, else one for each.  Mostly that is the
    schema of any file, so a scan by one footer is planned meanwhile."""
    with ThreadPoolExecutor(max_workers=1) as pool:
        guess = pool.submit(_infer, spark, ds, globs, merge=False)
        found = _surveyed(spark, ds, index, sample=True)
        try:
            guessed = guess.result()
        except Exception as exc:  # it met a damaged file, or leaves of different depth
            if is_path_not_found(exc) or not (isinstance(exc, ScanError) or _is_recoverable(exc)):
                raise
            guessed = None
    if any(g.kind == footers.UNSEEN for g in found.groups):
        # Tasks can't open the store by themselves: Spark merges all footers.
        return _read_listed(spark, replace(ds, schema_mode="merge"), globs, index)
    schemas = [spark.read.parquet(group.sample).schema for group in found.groups]
    merged = schemas[0] if len({g.deeper for g in found.groups}) == 1 else None
    for other in schemas[1:]:
        merged = merged and widened(merged, other)
    if merged is None:
        return _read_each(spark, ds, found.groups, schemas, listed), found.bad_leaves
    paths = [p for g in found.groups for p in g.paths] if found.bad_leaves else globs
    schema = _union_order(schemas[0], _with_partition_types(merged, listed, append_missing=True), listed)
    if guessed is not None and not found.bad_leaves and _same_data(guessed.schema, merged, listed) \
            and _casts_back(ds, guessed.schema, listed):
        return _in_order(guessed.select(*_retyped(guessed.schema, listed)), schema), []
    df = spark.read.schema(schema).option("basePath", ds.base_path).parquet(*paths)
    return _in_order(df, schema), found.bad_leaves


def _same_data(inferred: T.StructType, data: T.StructType, listed: dict[str, T.DataType]) -> bool:
    """The inferred columns are the given ones and partition levels."""
    keys = {k.lower() for k in listed}
    own = {f.name.lower(): f.dataType for f in inferred.fields}
    return all(own.get(f.name.lower()) == f.dataType for f in data.fields if f.name.lower() not in keys)


_INTEGERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def widened(a: T.StructType, b: T.StructType) -> T.StructType | None:
    """The columns of both, as a by-name union would type them; None where
    Parquet's reader can't read one of them as that type."""
    fields = {f.name.lower(): f for f in a.fields}
    for f in b.fields:
        own = fields.get(f.name.lower())
        kind = f.dataType if own is None else _wider(own.dataType, f.dataType)
        if kind is None:
            return None
        fields[f.name.lower()] = T.StructField(f.name if own is None else own.name, kind, True)
    return T.StructType(list(fields.values()))


def _wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        same = {f.name.lower(): f.dataType for f in a.fields}
        # (within a struct fields may be missing, not differ)
        return widened(a, b) if all(same.get(f.name.lower(), f.dataType) == f.dataType for f in b.fields) else None
    if a in _INTEGERS and b in _INTEGERS:
        return max(a, b, key=_INTEGERS.index)
    if {type(a), type(b)} <= {T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType} \
            and T.DoubleType() in (a, b):
        return T.DoubleType()
    return None


def _first_leaf_schema(spark: SparkSession, ds: DatasetSpec, index: LazyIndex) -> T.StructType:
    """Schema of the first existing leaf in list order: the first listed one
    if it exists, else the first in the index."""
    try:
        return spark.read.parquet(leaf_path(ds, tuple(p.values[0] for p in ds.partitions))).schema
    except AnalysisException as exc:
        if not is_path_not_found(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
    leaf, path = index().first_file()
    return spark.read.option("basePath", leaf).parquet(path).schema


def _union_order(first: T.StructType, merged: T.StructType,
                 listed: dict[str, T.DataType]) -> T.StructType:
    """Order columns as a by-name union of the leaves would: the first listed
    leaf's columns (a listed key in place if its files hold it, deeper
    partition levels after them), then the listed keys, then columns first
    seen in later leaves."""
    by_lower = {f.name.lower(): f for f in merged.fields}
    order: list[str] = []
    for name in [f.name for f in first.fields] + list(listed):
        f = by_lower.get(name.lower())
        if f is not None and f.name not in order:
            order.append(f.name)
    order += [f.name for f in merged.fields if f.name not in order]
    return T.StructType([by_lower[n.lower()] for n in order])


def _infer(spark: SparkSession, ds: DatasetSpec, globs: list[str], merge: bool) -> DataFrame:
    try:
        return (spark.read.option("basePath", ds.base_path)
                .option("mergeSchema", "true" if merge else "false")
                .parquet(*globs))
    except AnalysisException as exc:
        if "UNABLE_TO_INFER_SCHEMA" in str(exc):
            raise ScanError(f"No data loaded for dataset '{ds.name}': the listed partitions "
                            f"under {ds.base_path} hold no Parquet files") from exc
        raise


def _casts_back(ds: DatasetSpec, inferred: T.StructType,
                listed: dict[str, T.DataType]) -> bool:
    """True when every listed partition column can be taken from the
    inferred read: either the inferred type is the listed type, or the
    listed values are text that Spark's inference changed type but not
    content (canonical ISO dates, canonical integers), so casting back to
    text restores every listed folder's value exactly.  Any other pair of
    types returns False and the scan does the exact typed read instead."""
    from .hive_paths import HIVE_NULL, directory_texts, hive_unescape

    inferred_types = {f.name.lower(): f.dataType for f in inferred.fields}
    for p in ds.partitions:
        t_inf, t_our = inferred_types.get(p.key.lower()), listed[p.key]
        if t_inf is None:
            return False
        if t_inf == t_our:
            continue
        if not isinstance(t_our, T.StringType):
            return False
        for v in p.values:
            for text in directory_texts(v):
                if text != HIVE_NULL and not _text_survives(hive_unescape(text), t_inf):
                    return False
    return True


def _text_survives(text: str, inferred: T.DataType) -> bool:
    """Casting ``text`` to the inferred type and back to text gives ``text``."""
    import datetime as dt

    if isinstance(inferred, T.DateType):
        try:
            return dt.date.fromisoformat(text).isoformat() == text and len(text) == 10
        except ValueError:
            return False
    if isinstance(inferred, (T.IntegerType, T.LongType)):
        try:
            return str(int(text)) == text
        except ValueError:
            return False
    return False


def _retyped(inferred: T.StructType, listed: dict[str, T.DataType]) -> list:
    by_lower = {k.lower(): (k, t) for k, t in listed.items()}
    cols = []
    for f in inferred.fields:
        hit = by_lower.get(f.name.lower())
        c = F.col(f"`{f.name}`")
        if hit is None:
            cols.append(c)
        elif f.dataType == hit[1] and f.name == hit[0]:
            cols.append(c)
        else:
            cols.append(c.cast(hit[1]).alias(hit[0]))
    return cols


def _is_recoverable(exc: Exception) -> bool:
    text = str(exc)
    return any(m in text for m in (
        "CANNOT_MERGE_SCHEMAS", "CANNOT_MERGE_INCOMPATIBLE_DATA_TYPE",
        "Failed to merge", "CANNOT_READ_FILE_FOOTER", "not a Parquet file",
        "FAILED_READ_FILE", "Could not read footer", "CONFLICTING_PARTITION_COLUMN_NAMES",
        "CONFLICTING_DIRECTORY_STRUCTURES"))


def _with_partition_types(schema: T.StructType, listed: dict[str, T.DataType],
                          append_missing: bool) -> T.StructType:
    by_lower = {k.lower(): (k, t) for k, t in listed.items()}
    fields, seen = [], set()
    for f in schema.fields:
        hit = by_lower.get(f.name.lower())
        if hit:
            fields.append(T.StructField(hit[0], hit[1], True))
            seen.add(hit[0].lower())
        else:
            fields.append(f)
    if append_missing:
        for k, t in listed.items():
            if k.lower() not in seen:
                fields.append(T.StructField(k, t, True))
    return T.StructType(fields)


def _first_line(exc: Exception) -> str:
    return str(exc).strip().splitlines()[0] if str(exc).strip() else type(exc).__name__

