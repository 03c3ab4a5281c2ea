"""The run: datasets -> temp views -> view chain -> query -> result.

Every run gets ``spark.newSession()``: its own temp views, SQL functions and
runtime SQL confs, on the caller's cluster.  It starts with the runtime confs
that the caller has set (a session time zone, ANSI mode, credentials).  The
caller's session is never changed, created or stopped.  Everything stays lazy until the caller acts on
``RunResult.df`` (or writes it), so Catalyst optimises the whole chain -
dataset scans, views and query - as one plan.
"""

from __future__ import annotations

import logging
import re
import sys
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.params import substitute
from ..sources.partition_scan import Scan, scan_dataset
from ..sources.text_files import driver_file, read_whole_text
from ..spec import RunSpec, SpecError

log = logging.getLogger("sqlrun")

# The session profile applied when a run gives none (adaptive
# execution with partition coalescing, corrected calendar rebasing for
# Parquet dates and INT96 timestamps), plus skew-join splitting.  These are
# runtime SQL confs; on Spark 4.1 they restate the defaults, and are set
# explicitly so a run does not depend on what a cluster's defaults happen to be.
DEFAULT_PROFILE: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
    "spark.sql.parquet.datetimeRebaseModeInRead": "CORRECTED",
    "spark.sql.parquet.int96RebaseModeInRead": "CORRECTED",
    "spark.sql.parquet.int96RebaseModeInWrite": "CORRECTED",
}

# Confs Spark accepts at runtime but that have no effect once the context runs.
_LAUNCH_ONLY = {"spark.default.parallelism"}
_HADOOP_PREFIX = "spark.hadoop."

# Spark lists many partition folders with a job of up to this many tasks
# (default 10000), one folder per task below that.
LISTING_PARALLELISM = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


class ViewError(RuntimeError):
    pass


@dataclass
class RunResult:
    session: SparkSession
    spec: RunSpec
    df: DataFrame
    scans: dict[str, Scan]
    skipped_confs: list[str] = field(default_factory=list)

    def coverage(self, with_rows: bool = True) -> DataFrame:
        """Coverage of every dataset, one row per requested leaf."""
        frames = [s.coverage(with_rows) for s in self.scans.values() if s.dataset.partitions]
        if not frames:
            raise ValueError("no partitioned dataset in this run")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def load_report(self) -> DataFrame:
        """Per dataset: requested partitions, how many were found, missing
        or unreadable, and the files and bytes they hold (one small
        aggregate over the coverage; repeated values count once per listing)."""
        from pyspark.sql import functions as F

        cov = self.coverage(with_rows=False)
        return cov.groupBy("dataset").agg(
            F.count(F.lit(1)).alias("requested"),
            F.sum((F.col("status") == "found").cast("int")).cast("bigint").alias("found"),
            F.sum((F.col("status") == "missing").cast("int")).cast("bigint").alias("missing"),
            F.sum((F.col("status") == "unreadable").cast("int")).cast("bigint").alias("unreadable"),
            F.sum("files").cast("bigint").alias("files"),
            F.sum("bytes").cast("bigint").alias("bytes"))

    def sql(self, query: str, parameters: Mapping[str, Any] | None = None,
            args: Mapping[str, Any] | None = None) -> DataFrame:
        """Run another query over the same registered datasets and views,
        with the run's parameters (extended by ``parameters``/``args``).
        The scans are not planned again: their views are already bound."""
        if not query.strip():
            raise SpecError("query cannot be empty")
        params = {**self.spec.parameters, **(parameters or {})}
        bound = {**self.spec.args, **(args or {})}
        return _sql(self.session, substitute(query, params), bound)

    def explain(self, mode: str = "formatted") -> None:
        """Print the physical plan of the whole run (scans, views, query):
        check ``PartitionFilters``/``PushedFilters``/``ReadSchema`` and the
        exchanges before running on a large cluster."""
        self.df.explain(mode=mode)

    def write(self, output_prefix: str | None = None, run_id: str | None = None) -> str:
        from ..sources.result_sink import write_result

        prefix = output_prefix or self.spec.output_prefix
        if not prefix or not prefix.strip():
            raise SpecError("no output prefix given")
        return write_result(self.df, prefix, run_id)


def runtime_confs(caller: SparkSession, fresh: SparkSession) -> dict[str, str]:
    """The confs that the caller's session has by now and a new one starts
    without."""
    has = fresh.conf.getAll
    return {k: v for k, v in caller.conf.getAll.items() if has.get(k) != v}


def apply_profile(session: SparkSession, conf: Mapping[str, str],
                  inherited: Mapping[str, str] = MappingProxyType({})) -> list[str]:
    """Set runtime confs: the default profile, over it what the caller's
    session has set (`inherited`), over both the given map, which replaces the
    default profile (an empty map means the defaults).

    * ``spark.hadoop.X`` is set as ``X`` on the run session: the session's
      file reads and writes build their Hadoop configuration from its confs,
      so e.g. filesystem credentials apply to this run only;
    * confs Spark refuses at runtime (executor sizing, packages, static SQL
      confs) and ones it accepts but ignores once running
      (``spark.default.parallelism``) are skipped and returned, not silently
      half-applied."""
    skipped = []
    for key, value in {**({} if conf else DEFAULT_PROFILE), **inherited, **(conf or {})}.items():
        if key in _LAUNCH_ONLY:
            skipped.append(key)
            continue
        target = key[len(_HADOOP_PREFIX):] if key.startswith(_HADOOP_PREFIX) else key
        try:
            session.conf.set(target, str(value))
        except Exception as exc:
            # Only a conf that is fixed at launch is passed over; an invalid value is an error.
            if "CANNOT_MODIFY" not in str(exc):
                if key not in (conf or DEFAULT_PROFILE):
                    continue  # the caller's own, no setting of the run
                raise SpecError(f"session conf {key}={value!r}: {exc}") from exc
            if key in (conf or DEFAULT_PROFILE):
                skipped.append(key)
    if skipped:
        log.warning("launch-time confs not applied to the run session: %s", skipped)
    return skipped


# Shuffles start with this many partitions and AQE coalesces them to its
# advisory size.  AQE merges small partitions but does not split large ones
# (beyond skew), so the start must grow with the cluster: 200 fixed
# partitions would be ~500 GB each on a 100 TB shuffle.
INITIAL_SHUFFLE_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def most_cores(session: SparkSession) -> int | None:
    """The cores that the application can grow to, by its configuration: the
    same whenever it is asked, unlike the executors alive at the moment."""
    try:
        conf = session.sparkContext.getConf()
        master = session.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            return session.sparkContext.defaultParallelism  # one process: fixed
    except Exception:  # no SparkContext handle (Spark Connect)
        return None
    if conf.get("spark.cores.max", None):
        return int(conf.get("spark.cores.max"))
    dynamic = conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true"
    executors = conf.get("spark.dynamicAllocation.maxExecutors" if dynamic else "spark.executor.instances", None)
    cores = conf.get("spark.executor.cores", None)
    return int(executors) * int(cores) if executors and cores and executors.isdigit() else None


def size_to_cluster(session: SparkSession, conf: Mapping[str, str],
                    inherited: Mapping[str, str] = MappingProxyType({})) -> None:
    """Initial shuffle width by the most cores that the application can have,
    never under the cluster's own setting or over one that was chosen.  Folder
    listing keeps Spark's default on a cluster; in one local process, whose
    cores never change, a task lists a batch of folders instead of one."""
    conf = {**inherited, **(conf or {})}
    cores = most_cores(session)
    if cores is None:
        return
    local = session.sparkContext.master.startswith("local[") or session.sparkContext.master == "local"
    if local and LISTING_PARALLELISM not in conf and \
            not session.sparkContext.getConf().contains(LISTING_PARALLELISM):
        session.conf.set(LISTING_PARALLELISM, str(max(8, 2 * cores)))
    if INITIAL_SHUFFLE_PARTITIONS not in conf and \
            not session.conf.get(INITIAL_SHUFFLE_PARTITIONS, None):
        shuffle = int(session.conf.get("spark.sql.shuffle.partitions"))
        session.conf.set(INITIAL_SHUFFLE_PARTITIONS, str(max(shuffle, 4 * cores)))


def run(spark: SparkSession, spec: RunSpec | Mapping[str, Any], *,
        query: str | None = None,
        parameters: Mapping[str, Any] | None = None,
        args: Mapping[str, Any] | None = None) -> RunResult:
    """Load datasets, run the view chain and the query; return a lazy result.

    ``query`` overrides the spec's query when non-blank.  ``parameters``
    (text templating) and ``args`` (typed, bound by Spark) extend the spec's.
    """
    if not isinstance(spec, RunSpec):
        spec = RunSpec.from_dict(spec)
    spec = spec.with_query(query)
    if not spec.query.strip():
        raise SpecError("query cannot be empty")
    params = {**spec.parameters, **(parameters or {})}
    bound = {**spec.args, **(args or {})}

    try:
        session = spark.newSession()
    except Exception:  # pragma: no cover - clients without newSession
        log.warning("newSession() unavailable: the run shares the caller's session")
        session = spark
    inherited = runtime_confs(spark, session) if session is not spark else {}
    skipped = apply_profile(session, spec.session_config, inherited)
    size_to_cluster(session, spec.session_config, inherited)

    # Spec-level failures first: view files are read and every ${NAME} in
    # the views and the query is resolved before any dataset is listed.
    view_texts = [substitute(raw, params) for raw in _view_texts(session, spec)]
    query_text = substitute(spec.query, params)

    # Register every dataset before any view: SQL views resolve names late.
    # Planning a scan is driver-side listing and footer work, independent per
    # dataset, so the datasets are planned concurrently.
    scans: dict[str, Scan] = {}
    for ds, scan in zip(spec.datasets, _plan_scans(session, spec)):
        scan.df.createOrReplaceTempView(ds.name)
        scans[ds.name] = scan

    for view, text in zip(spec.views, view_texts):
        if not text.strip():
            log.warning("skipping empty view %s", view.name)
            continue
        log.info("view %s:\n%s", view.name, text)
        if _is_plain_query(text):
            log.warning("view %s is a query, not a statement: it is analysed and its "
                        "result is dropped", view.name)
        try:
            _sql(session, text, bound)
        except Exception as exc:
            raise ViewError(f"view '{view.name}' failed: {exc}") from exc

    log.info("query:\n%s", query_text)
    df = _sql(session, query_text, bound)
    return RunResult(session, spec, df, scans, skipped)


_QUERY_START = re.compile(r"^\s*(?:(?:--[^\n]*\n|/\*.*?\*/)\s*)*\(*\s*(SELECT|WITH|VALUES|FROM|TABLE)\b",
                          re.IGNORECASE | re.DOTALL)


def _is_plain_query(text: str) -> bool:
    return bool(_QUERY_START.match(text))


def _view_texts(session: SparkSession, spec: RunSpec) -> list[str]:
    """View texts in chain order; view files are read concurrently (each is
    a small Spark read), the statements still run strictly in order."""
    paths = [v.path for v in spec.views if v.sql is None]
    texts: dict[str, str] = {}
    if len(paths) > 1:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(max_workers=min(8, len(paths))) as pool:
            texts = dict(zip(paths, pool.map(lambda p: read_whole_text(session, p), paths)))
    elif paths:
        texts = {paths[0]: read_whole_text(session, paths[0])}
    return [v.sql if v.sql is not None else texts[v.path] for v in spec.views]


def _plan_scans(session: SparkSession, spec: RunSpec) -> list[Scan]:
    if len(spec.datasets) == 1:
        return [scan_dataset(session, spec.datasets[0])]
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=min(8, len(spec.datasets))) as pool:
        return list(pool.map(lambda ds: scan_dataset(session, ds), spec.datasets))


def _sql(session: SparkSession, text: str, bound: Mapping[str, Any]) -> DataFrame:
    text = text.strip().rstrip(";")
    if bound:
        return session.sql(text, args=dict(bound))
    return session.sql(text)


def launch(spec_path: str) -> tuple[SparkSession, RunSpec]:
    """The session for a spec, and the spec.

    Confs that are fixed at launch take effect if this call starts the
    application.  A spec on the driver is read before that; one that only Spark
    reaches (a Hadoop path) is read by a first session, which makes way for the
    real one if the spec has launch confs that it lacks.  An application that
    runs already, or whose driver lives on the cluster and ends with its
    context, is left as it is: ``run`` reports the confs that it skips."""
    builder = SparkSession.builder
    if driver_file(spec_path):
        spec = RunSpec.load(None, spec_path, require_output=True)
        return _configured(builder, spec).getOrCreate(), spec
    ours = SparkSession.getActiveSession() is None
    first = builder.getOrCreate()
    spec = RunSpec.load(first, spec_path, require_output=True)
    lacking = launch_confs(first, spec.session_config)
    if not lacking or not ours:
        return first, spec
    if first.sparkContext.getConf().get("spark.submit.deployMode", "client") == "cluster":
        log.warning("the driver runs on the cluster: launch confs %s need spark-submit", sorted(lacking))
        return first, spec
    log.info("starting again with the spec's launch confs: %s", sorted(lacking))
    first.stop()
    return _configured(builder, spec).getOrCreate(), spec


def _configured(builder: Any, spec: RunSpec) -> Any:
    for key, value in spec.session_config.items():
        builder = builder.config(key, value)
    return builder


def launch_confs(spark: SparkSession, conf: Mapping[str, str]) -> dict[str, str]:
    """Those of `conf` that a running application can't take on and has
    otherwise."""
    have = spark.sparkContext.getConf()
    return {k: v for k, v in conf.items() if k.startswith("spark.") and not k.startswith(_HADOOP_PREFIX)
            and (k in _LAUNCH_ONLY or not spark.conf.isModifiable(k)) and have.get(k, None) != str(v)}


def main(argv: list[str] | None = None) -> int:
    """``python -m sqlrun.plans.runner SPEC_PATH [RUN_ID] [--query SQL] [--preview N]``

    Runs a JSON or YAML spec on the current cluster, writes the result under
    ``outputPrefix/RUN_ID`` (a new UUID when no id is given) and prints that
    path; ``--query`` overrides the spec's query, ``--preview N`` also prints
    at most N result rows."""
    import argparse

    parser = argparse.ArgumentParser(prog="sqlrun")
    parser.add_argument("spec_path")
    parser.add_argument("run_id", nargs="?", default=None)
    parser.add_argument("--query", default=None)
    parser.add_argument("--preview", type=int, default=0)
    try:
        ns = parser.parse_args(sys.argv[1:] if argv is None else argv)
    except SystemExit:
        return 1
    if not ns.spec_path.strip() or (ns.run_id is not None and not ns.run_id.strip()):
        print("spec path and run id must be non-empty", file=sys.stderr)
        return 1
    spark, spec = launch(ns.spec_path)
    result = run(spark, spec, query=ns.query)
    path = result.write(run_id=ns.run_id)
    print(path)
    if ns.preview > 0:
        from ..sources.result_sink import preview

        preview(spark, path, ns.preview).show(ns.preview, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
