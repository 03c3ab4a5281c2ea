"""Partition coverage: which listed leaves were found, and how much they hold.

Returned as a DataFrame, one row per *requested* leaf (a repeated value gives
repeated rows), so it can be filtered, joined or written like any result:

    dataset, leaf_index, <one string column per key>, path, status,
    files, bytes, rows

* The requested side is generated inside Spark from ``range(n_leaves)`` by
  mixed-radix arithmetic over the listed values (later keys vary fastest), so
  the driver never materialises the product.
* ``files``/``bytes`` come from the scan's file index, which lists the globs at
  most once however often it is asked: no file body is read.
* ``rows`` counts rows per leaf from the scan with only partition columns
  requested (Parquet answers this from footers).
Both sides are aggregated to one row per leaf before the join, so the join is
leaf-count sized whatever the data volume.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.hive_paths import canonical_text, column_type, hive_escape

if TYPE_CHECKING:
    from ..sources.partition_scan import Scan


def col(name: str):
    """A column by its exact name (partition keys may hold dots)."""
    return F.col("`" + name.replace("`", "``") + "`")


def value_display(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return repr(v)
    return str(v)


def string_array(spark, values: list[str | None]):
    """An array<string> literal built as one SQL expression: one call into
    the JVM however long the value list (a column per value costs one call
    each, seconds for ten thousand values).  Sessions that take string
    literals raw (``spark.sql.parser.escapedStringLiterals``), and values
    that look like ``${...}`` variables, get the per-value form, which needs
    no escaping and is not substituted."""
    raw_literals = spark.conf.get("spark.sql.parser.escapedStringLiterals", "false").lower() == "true"
    # SQL text also goes through Spark's ${...} variable substitution
    if raw_literals or any(v is not None and "${" in v for v in values):
        return F.array(*[F.lit(v).cast("string") for v in values])
    parts = ["CAST(NULL AS STRING)" if v is None else
             "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
    return F.expr("array(" + ", ".join(parts) + ")")


def requested_leaves(scan: "Scan") -> DataFrame:
    ds = scan.dataset
    spark = scan.spark
    n = ds.leaf_count
    df = spark.range(n).withColumnRenamed("id", "leaf_index")
    stride = n
    path = [F.lit(ds.base_path)]
    for p in ds.partitions:
        size = len(p.values)
        stride //= size
        pos = F.expr(f"CAST((leaf_index div {stride}) % {size} AS INT) + 1")
        shown = string_array(spark, [value_display(v) for v in p.values])
        texts = string_array(spark, [canonical_text(v) for v in p.values])
        df = df.withColumn(p.key, F.element_at(shown, pos)) \
               .withColumn(f"_dir_{p.key}", F.element_at(texts, pos))
        path += [F.lit("/" + hive_escape(p.key) + "="), col(f"_dir_{p.key}")]
    return df.withColumn("path", F.concat(*path))


def coverage_frame(scan: "Scan", with_rows: bool = True) -> DataFrame:
    ds = scan.dataset
    keys = [p.key for p in ds.partitions]
    spark = scan.spark
    req = requested_leaves(scan).withColumn("dataset", F.lit(ds.name))
    dir_cols = [f"_dir_{k}" for k in keys]

    files = scan.index().files.select("length", *[col(c) for c in dir_cols])
    for p in ds.partitions:  # booleans may be spelled True/False on storage
        if column_type(p).typeName() == "boolean":
            files = files.withColumn(f"_dir_{p.key}", F.lower(col(f"_dir_{p.key}")))
    stats = files.groupBy(*[col(c) for c in dir_cols]).agg(F.count(F.lit(1)).alias("files"),
                                         F.sum("length").alias("bytes"))
    out = req.join(stats, on=dir_cols, how="left")

    # Unreadable leaves are joined on, however many there are.
    bad = spark.createDataFrame([tuple(b[k] for k in keys) + (True,) for b in scan.bad_leaves],
                                ", ".join(f"b{i} string" for i in range(len(keys))) + ", unreadable boolean")
    same = [col(c).eqNullSafe(F.col(f"b{i}")) for i, c in enumerate(dir_cols)]
    out = out.join(bad, on=same, how="left").drop(*[f"b{i}" for i in range(len(keys))])
    bad_expr = F.coalesce(F.col("unreadable"), F.lit(False))

    if with_rows:
        typed = {p.key: column_type(p) for p in ds.partitions}
        counts = scan.leaf_df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows"))
        counts = counts.select(*[col(k).alias(f"_v_{k}") for k in keys], "rows")
        cond = None
        for k in keys:
            c = col(k).cast(typed[k]).eqNullSafe(col(f"_v_{k}"))
            cond = c if cond is None else cond & c
        out = out.join(counts, on=cond, how="left").drop(*[f"_v_{k}" for k in keys])
    else:
        out = out.withColumn("rows", F.lit(None).cast("bigint"))

    status = (F.when(bad_expr, F.lit("unreadable"))
              .when(F.coalesce(F.col("files"), F.lit(0)) > 0, F.lit("found"))
              .otherwise(F.lit("missing")))
    return out.select(
        "dataset", "leaf_index", *[col(k) for k in keys], "path", status.alias("status"),
        F.coalesce("files", F.lit(0)).cast("bigint").alias("files"),
        F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"),
        F.when(bad_expr, F.lit(None)).otherwise(F.coalesce("rows", F.lit(0))).cast("bigint").alias("rows"),
    )
