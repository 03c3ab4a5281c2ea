"""Parameterised Spark SQL over partition-listed Parquet datasets.

    from sqlrun import run, RunSpec
    result = run(spark, {
        "datasets": [{"name": "events", "path": "s3://b/events",
                      "partitions": [{"key": "date", "values": ["2024-01-01"]}]}],
        "views": [{"name": "daily", "sql": "CREATE TEMPORARY VIEW daily AS ..."}],
        "parameters": {"LIMIT": 100},
        "query": "SELECT * FROM daily LIMIT ${LIMIT}",
    })
    result.df            # lazy DataFrame
    result.coverage()    # which listed partitions were found
    result.write("s3://b/out")   # -> s3://b/out/<run id>
"""

__version__ = "0.1.0"

from .functions.params import ParameterError, substitute
from .plans.runner import DEFAULT_PROFILE, RunResult, ViewError, run
from .sources.partition_scan import Scan, ScanError, scan_dataset
from .sources.result_sink import (
    manifest, manifest_summary, preview, read_ordered, read_ranked, read_result, write_result,
)
from .spec import DatasetSpec, PartitionKey, RunSpec, SpecError, ViewSpec

__all__ = [
    "__version__",
    "DEFAULT_PROFILE", "DatasetSpec", "ParameterError", "PartitionKey", "RunResult",
    "RunSpec", "Scan", "ScanError", "SpecError", "ViewError", "ViewSpec",
    "manifest", "manifest_summary", "preview", "read_ordered", "read_ranked",
    "read_result", "run", "scan_dataset",
    "substitute", "write_result",
]
