"""Shared comparison used by tools/check_oracle.py and the tests."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


# Floats are compared exactly unless ORACLE_LOOSE is set (then to 6 places).
STRICT = not os.environ.get("ORACLE_LOOSE")


def norm(v, strict: bool = STRICT):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if strict else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, strict) for x in v)
    return v


def kind(t: str) -> str:
    t = t.lower()
    for names, k in ((("int", "long", "short", "byte"), "int"), (("double", "float", "real"), "float"),
                     (("decimal",), "decimal"), (("timestamp",), "timestamp"), (("date",), "date"),
                     (("string", "varchar", "char"), "string"), (("bool",), "bool")):
        if any(x in t for x in names):
            return k
    return t


def compare(df, con, sql: str, strict: bool = STRICT) -> list[str]:
    """Problems found between a Spark DataFrame and a DuckDB query ([] = equal)."""
    rows = df.collect()
    s_cols = df.columns
    s_types = [kind(f.dataType.simpleString()) for f in df.schema.fields]
    rel = con.sql(sql)
    o_rows = rel.fetchall()
    o_cols = rel.columns
    o_types = [kind(str(t)) for t in rel.types]
    if sorted(s_cols) != sorted(o_cols):
        return [f"columns {sorted(s_cols)} vs {sorted(o_cols)}"]
    problems = []
    st, ot = dict(zip(s_cols, s_types)), dict(zip(o_cols, o_types))
    diff = {c: (st[c], ot[c]) for c in s_cols if st[c] != ot[c]}
    if diff:
        problems.append(f"types {diff}")
    if len(rows) != len(o_rows):
        problems.append(f"rows {len(rows)} vs {len(o_rows)}")
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    oi = [o_cols.index(c) for c in order]
    a = Counter(tuple(norm(r[i], strict) for i in si) for r in rows)
    b = Counter(tuple(norm(r[i], strict) for i in oi) for r in o_rows)
    if a != b:
        problems.append(f"values differ: spark-only {list((a - b).items())[:2]} "
                        f"oracle-only {list((b - a).items())[:2]}")
    return problems
