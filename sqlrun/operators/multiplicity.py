"""Bag semantics for repeated partition values.

Listing a value twice must return that value's rows twice (a union of the same
leaf with itself).  The scan reads every distinct leaf once; rows of a leaf
whose values were repeated are then multiplied in place with a generator.
This is a narrow, codegen-friendly step: no join, no shuffle, no broadcast,
and the expression size depends only on how many values the spec repeats.
"""

from __future__ import annotations

from collections import Counter
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import DatasetSpec
from ..sources.hive_paths import canonical_text, column_type


def value_multiplicities(values: tuple[Any, ...]) -> dict[Any, int]:
    """Repeat count per leaf folder: values are counted by the folder text
    they select (``1`` and ``"1"`` both select ``k=1``).  Returns one
    representative value per repeated folder."""
    counts = Counter(canonical_text(v) for v in values)
    first: dict[str, Any] = {}
    for v in values:
        first.setdefault(canonical_text(v), v)
    return {first[t]: n for t, n in counts.items() if n > 1}


def multiplicity_expr(ds: DatasetSpec) -> Column | None:
    """Per-row multiplicity: product over keys of the repeat count of the
    row's value (1 for values listed once); None if nothing repeats."""
    factors = []
    for p in ds.partitions:
        dups = value_multiplicities(p.values)
        if not dups:
            continue
        typ = column_type(p)
        expr = None
        for v, n in dups.items():
            c = F.col(f"`{p.key}`")
            cond = c.isNull() if v is None else c == F.lit(v).cast(typ)
            expr = (F.when(cond, F.lit(n)) if expr is None else expr.when(cond, F.lit(n)))
        factors.append(expr.otherwise(F.lit(1)))
    if not factors:
        return None
    out = factors[0]
    for f in factors[1:]:
        out = out * f
    return out


def apply_multiplicity(df: DataFrame, ds: DatasetSpec) -> DataFrame:
    mult = multiplicity_expr(ds)
    if mult is None:
        return df
    cols = df.columns
    marker = "__sqlrun_copy"
    return (df.withColumn(marker, F.explode(F.sequence(F.lit(1), mult.cast("int"))))
              .select(*[F.col(f"`{c}`") for c in cols]))
