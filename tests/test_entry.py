"""The driver contract of __spark_entry__.py."""

import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as entry
from sqlrun import catalog

from .conftest import SF_SMALL

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
# The training-data queries have tests of their own.
CATALOGUE = sorted(catalog.QUERIES)


def test_contract_shapes():
    assert QUERIES and all(callable(f) for f in QUERIES.values())
    assert set(ORACLES) <= set(QUERIES)
    assert all(isinstance(q, str) and q.strip() for q in ORACLES.values())


def test_entry_schema_is_stable(spark):
    a, b = entry.entry(spark), entry.entry(spark)
    assert isinstance(a, DataFrame) and a.schema == b.schema
    assert [f.dataType.simpleString() for f in a.schema.fields] == ["bigint", "string", "bigint"]


@pytest.mark.parametrize("name", CATALOGUE)
def test_columns_are_named_and_unique(spark, name):
    cols = QUERIES[name](spark, SF_SMALL).columns
    assert len(cols) == len({c.lower() for c in cols})
    # every computed column carries an alias (no generated names such as count(1))
    assert not any("(" in c or " " in c for c in cols), cols


def test_whatever_the_training_data_operators_miss_the_catalogue_stays(scratch):
    """A package that they import can't be imported: the catalogue registers."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(entry.__file__))
    script = ("import sys; sys.modules['pyarrow'] = None\n"
              "import __spark_entry__ as e\nprint('GOT', len(e.queries()), len(e.oracle_sql()))")
    out = subprocess.run([sys.executable, "-c", script], env={**os.environ, "PYTHONPATH": root}, cwd=scratch,
                         capture_output=True, text=True, timeout=120)
    assert f"GOT {len(CATALOGUE)} {len(catalog.ORACLES)}" in out.stdout, out.stderr[-1500:]
