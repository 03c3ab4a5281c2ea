"""Summarise the physical plan of every catalogue query (markdown table):
shuffles, join strategies, broadcasts, windows, generators, scans.

    python tools/plan_report.py [SF_DIR] > PLANS_TABLE.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

MARKERS = [
    ("Exchange hashpartitioning", "hash shuffle"),
    ("Exchange rangepartitioning", "range shuffle"),
    ("Exchange SinglePartition", "single-partition"),
    ("BroadcastExchange", "broadcast"),
    ("BroadcastHashJoin", "BHJ"),
    ("SortMergeJoin", "SMJ"),
    ("ShuffledHashJoin", "SHJ"),
    ("BroadcastNestedLoopJoin", "BNLJ"),
    ("CartesianProduct", "cartesian"),
    ("Window", "window"),
    ("Generate", "generate"),
    ("TakeOrderedAndProject", "top-k"),
    ("partial_", "partial agg"),
    ("Expand", "expand"),
]


def summarise(plan: str) -> str:
    parts = []
    for marker, label in MARKERS:
        n = plan.count(marker)
        if n:
            parts.append(f"{label}×{n}" if n > 1 else label)
    return ", ".join(parts) or "narrow only"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.adaptive.enabled", "false")  # show the static plan
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from sqlrun import catalog

    catalog.load_all()

    print("| Query | Scans | Plan operators |")
    print("|---|---|---|")
    for name, fn in sorted(catalog.QUERIES.items()):
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = len(re.findall(r"FileScan \w+", plan)) + plan.count("Scan ExistingRDD") \
            + plan.count("LocalTableScan") + plan.count("Range (")
        print(f"| `{name}` | {scans} | {summarise(plan)} |")


if __name__ == "__main__":
    main()
