"""Run specification: datasets, partition lists, views, parameters, query.

A run spec is plain data (a dict or a JSON document).  This module turns it
into frozen dataclasses and checks it *before* any Spark job starts, so a bad
spec fails fast on the driver instead of half-way through a cluster run.
"""

from __future__ import annotations

import json
import logging
import re
from dataclasses import dataclass, field, replace
from typing import Any, Mapping, Sequence

from pyspark.sql import SparkSession

log = logging.getLogger("sqlrun")

_IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")

# Spark type names accepted for a declared partition column type.
_DECLARABLE_TYPES = {
    "string", "int", "integer", "bigint", "long", "smallint", "tinyint",
    "double", "float", "boolean", "date", "timestamp", "timestamp_ntz",
}


class SpecError(ValueError):
    """A run spec that cannot be executed as written."""


@dataclass(frozen=True)
class PartitionKey:
    """One partition level: a directory key and the values wanted for it.

    ``values`` keeps order and duplicates: a value listed twice reads its
    leaves twice (bag semantics, as a union of the same leaf would).
    ``type`` optionally declares the Spark SQL type of the column; without it
    the type follows the Python values (see ``sources.hive_paths``).
    """

    key: str
    values: tuple[Any, ...]
    type: str | None = None


@dataclass(frozen=True)
class DatasetSpec:
    """A Parquet dataset registered as a temporary view named ``name``."""

    name: str
    path: str
    partitions: tuple[PartitionKey, ...] = ()
    # Optional DDL schema of the data columns ("a INT, b STRING"); skips
    # footer-based inference, which is the cheapest option at large scale.
    schema: str | None = None
    # "merge": superset of all file schemas (Spark's parallel footer merge);
    # "leaf": superset of one file's schema for each leaf of a partition list;
    # "first": schema of one footer only (Spark's default).  Unset means
    # "merge" for a partition list (a union of leaves sees every leaf's
    # columns) and "first" for a plain path (one Spark read).
    schema_mode: str | None = None
    # Partition lists: look at the last bytes of every file, so that leaves
    # without a readable file are left out and damaged files named before the
    # scan runs, in the modes that don't read every footer anyway.
    check_files: bool = True

    @property
    def merge_schema(self) -> bool:
        mode = self.schema_mode or ("merge" if self.partitions else "first")
        return mode == "merge"

    @property
    def has_many_roots(self) -> bool:
        """The base path of a partition list is a glob."""
        return bool(self.partitions) and any(ch in self.path for ch in "*?[{")

    @staticmethod
    def from_dict(raw: Mapping[str, Any]) -> "DatasetSpec":
        """One dataset entry (``name``, ``path``, ``partitions``, optional
        ``schema`` / ``schema_mode`` / ``check_files``), checked as in a run
        spec."""
        return _dataset(raw, 0)

    @property
    def base_path(self) -> str:
        return self.path.rstrip("/")

    @property
    def leaf_count(self) -> int:
        n = 1
        for p in self.partitions:
            n *= len(p.values)
        return n


@dataclass(frozen=True)
class ViewSpec:
    """One statement of the view chain; ``name`` is a label for messages.

    Either ``sql`` holds the text, or ``path`` names a file read (through
    Spark, so any cluster path works) when the run starts."""

    name: str
    sql: str | None = None
    path: str | None = None


@dataclass(frozen=True)
class RunSpec:
    datasets: tuple[DatasetSpec, ...]
    query: str
    output_prefix: str | None = None
    views: tuple[ViewSpec, ...] = ()
    parameters: Mapping[str, Any] = field(default_factory=dict)
    args: Mapping[str, Any] = field(default_factory=dict)
    session_config: Mapping[str, str] = field(default_factory=dict)

    # ------------------------------------------------------------------ build
    @staticmethod
    def from_dict(raw: Mapping[str, Any], *, require_output: bool = False) -> "RunSpec":
        if not isinstance(raw, Mapping):
            raise SpecError("run spec must be a mapping")
        datasets_raw = raw.get("datasets")
        if not isinstance(datasets_raw, list) or not datasets_raw:
            raise SpecError("'datasets' must be a non-empty list")
        query = raw.get("query", "")
        if not isinstance(query, str):
            raise SpecError("'query' must be a string")
        out = raw.get("outputPrefix", raw.get("output_prefix"))
        if require_output and (not isinstance(out, str) or not out.strip()):
            raise SpecError("'outputPrefix' must be a non-blank string")
        views_raw = raw.get("views") or []
        if not isinstance(views_raw, list):
            raise SpecError("'views' must be a list")
        views = tuple(_view(v, i) for i, v in enumerate(views_raw))
        conf = raw.get("sparkSessionConfig", raw.get("session_config")) or {}
        if not isinstance(conf, Mapping):
            raise SpecError("'sparkSessionConfig' must be a mapping")
        for key in ("parameters", "args"):
            if raw.get(key) is not None and not isinstance(raw.get(key), Mapping):
                raise SpecError(f"'{key}' must be a mapping of names to values")
        if raw.get("sparkSubmitConfig"):
            log.warning("sparkSubmitConfig holds launch-time settings for spark-submit; "
                        "a run on an existing session does not apply them")
        spec = RunSpec(
            datasets=tuple(_dataset(d, i) for i, d in enumerate(datasets_raw)),
            query=query,
            output_prefix=out,
            views=views,
            parameters=dict(raw.get("parameters") or {}),
            args=dict(raw.get("args") or {}),
            session_config={str(k): str(v) for k, v in conf.items()},
        )
        spec.check()
        return spec

    @staticmethod
    def from_json(text: str, **kw: Any) -> "RunSpec":
        if not text.strip():
            raise SpecError("run spec document is empty")
        return RunSpec.from_dict(json.loads(text), **kw)

    @staticmethod
    def from_yaml(text: str, **kw: Any) -> "RunSpec":
        """A YAML run config (datasets, views as SQL file paths, parameters,
        query, outputPrefix, sparkSessionConfig).  Keys for job submission
        and cloud access are ignored; an unquoted YAML date is taken as its
        ISO text, the same folder a quoted date selects."""
        try:
            import yaml
        except ImportError as exc:  # pragma: no cover - PyYAML is optional
            raise SpecError("YAML run specs need PyYAML installed") from exc
        if not text.strip():
            raise SpecError("run spec document is empty")
        return RunSpec.from_dict(_dates_as_text(yaml.safe_load(text)), **kw)

    @staticmethod
    def load(spark: SparkSession, path: str, **kw: Any) -> "RunSpec":
        """Read a JSON (or ``.yaml``/``.yml``) run spec from any
        Hadoop-readable path (local, HDFS, object store) through Spark, so
        the driver needs no cloud client."""
        from .sources.text_files import read_whole_text

        text = read_whole_text(spark, path)
        if path.lower().endswith((".yaml", ".yml")):
            return RunSpec.from_yaml(text, **kw)
        return RunSpec.from_json(text, **kw)

    # ------------------------------------------------------------------ check
    def check(self) -> None:
        seen: set[str] = set()
        for d in self.datasets:
            low = d.name.lower()
            if low in seen:
                raise SpecError(f"dataset name '{d.name}' is used twice")
            seen.add(low)
        for v in self.views:
            if not isinstance(v, ViewSpec) or (v.sql is None) == (v.path is None):
                raise SpecError("each view needs exactly one of 'sql' or 'path'")

    def with_query(self, query: str | None) -> "RunSpec":
        """Query override: a non-blank replacement wins, the rest stays."""
        if query is None or not query.strip():
            return self
        return replace(self, query=query)


def _dates_as_text(node: Any) -> Any:
    import datetime as dt

    if isinstance(node, (dt.date, dt.datetime)):
        return node.isoformat()
    if isinstance(node, Mapping):
        return {k: _dates_as_text(v) for k, v in node.items()}
    if isinstance(node, list):
        return [_dates_as_text(v) for v in node]
    return node


def _view(v: Any, i: int) -> ViewSpec:
    if isinstance(v, ViewSpec):
        return v
    if isinstance(v, str):  # a bare string names a SQL file
        if not v.strip():
            raise SpecError(f"view at index {i} has an empty path")
        return ViewSpec(name=v, path=v)
    if not isinstance(v, Mapping):
        raise SpecError(f"view at index {i} must be a mapping or a file path")
    if "sql" in v:
        if "name" not in v:
            raise SpecError(f"view at index {i} is missing 'name'")
        return ViewSpec(name=str(v["name"]), sql=str(v["sql"]))
    if "path" in v:
        return ViewSpec(name=str(v.get("name", v["path"])), path=str(v["path"]))
    raise SpecError(f"view at index {i} needs 'sql' or 'path'")


def _dataset(d: Any, i: int) -> DatasetSpec:
    if isinstance(d, DatasetSpec):
        return d
    if not isinstance(d, Mapping):
        raise SpecError(f"dataset at index {i} must be a mapping")
    for req in ("name", "path"):
        if req not in d:
            raise SpecError(f"dataset at index {i} is missing '{req}'")
    name, path = d["name"], d["path"]
    if not isinstance(name, str) or not _IDENTIFIER.match(name):
        raise SpecError(f"dataset name {name!r} is not a plain SQL identifier")
    if not isinstance(path, str) or not path.strip().rstrip("/"):
        raise SpecError(f"dataset '{name}' has an empty path")
    parts_raw = d.get("partitions") or []
    if not isinstance(parts_raw, (list, tuple)):
        raise SpecError(f"dataset '{name}': 'partitions' must be a list")
    parts = tuple(_partition(p, j, name) for j, p in enumerate(parts_raw))
    keys = [p.key.lower() for p in parts]
    if len(set(keys)) != len(keys):
        raise SpecError(f"dataset '{name}' lists a partition key twice")
    mode = d.get("schema_mode")
    if mode not in (None, "merge", "leaf", "first"):
        raise SpecError(f"dataset '{name}': schema_mode must be 'merge', 'leaf' or 'first'")
    if mode == "leaf" and not parts:
        raise SpecError(f"dataset '{name}': schema_mode 'leaf' needs a partition list")
    checked = d.get("check_files", True)
    if not isinstance(checked, bool):
        raise SpecError(f"dataset '{name}': check_files must be true or false")
    return DatasetSpec(name=name, path=path, partitions=parts,
                       schema=d.get("schema"), schema_mode=mode, check_files=checked)


def _partition(p: Any, j: int, ds: str) -> PartitionKey:
    if isinstance(p, PartitionKey):
        return p
    if not isinstance(p, Mapping):
        raise SpecError(f"dataset '{ds}': partition at index {j} must be a mapping")
    if "key" not in p:
        raise SpecError(f"dataset '{ds}': partition at index {j} is missing 'key'")
    if "values" not in p:
        raise SpecError(f"dataset '{ds}': partition '{p['key']}' is missing 'values'")
    key, values = p["key"], p["values"]
    if not isinstance(key, str) or not key or "/" in key or "=" in key:
        raise SpecError(f"dataset '{ds}': bad partition key {key!r}")
    if isinstance(values, (str, bytes)) or not isinstance(values, Sequence):
        raise SpecError(f"dataset '{ds}': values of '{key}' must be a list")
    if not values:
        raise SpecError(f"dataset '{ds}': partition '{key}' has an empty values list")
    for v in values:
        if not (v is None or isinstance(v, (str, int, float, bool))):
            raise SpecError(f"dataset '{ds}': value {v!r} of '{key}' is not a scalar")
    typ = p.get("type")
    if typ is not None and str(typ).lower() not in _DECLARABLE_TYPES:
        raise SpecError(f"dataset '{ds}': unsupported partition type {typ!r}")
    return PartitionKey(key=key, values=tuple(values), type=typ)
