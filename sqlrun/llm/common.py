"""Helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared_folder import shared_dir

# Fixed value: a word of the size and quality contracts is a run of anything
# but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder."""
    return f"{shared_dir(spark)}/sqlrun-llm/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back.  This cuts the
    lineage, so a lost executor costs one re-read, and fixes the values of
    expressions that would differ between runs of a task.  Tables of whole
    texts ask for a stronger `compression`."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(taken: Iterable[str], base: str) -> str:
    """`base`, or `base_1`, … : a name that no column in `taken` has."""
    used, name, k = {c.lower() for c in taken}, base, 0
    while name.lower() in used:
        k += 1
        name = f"{base}_{k}"
    return name


def quoted(name: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def sealed(docs: DataFrame) -> Column:
    """All columns of `docs` as one struct, out of reach of names that an
    operator adds; ``opened`` takes them out again."""
    return F.struct(*map(quoted, docs.columns))


def opened(df: DataFrame, row: str, columns: Iterable[str]) -> DataFrame:
    return df.select(*(F.col(row).getField(c).alias(c) for c in columns))


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
