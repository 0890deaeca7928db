"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from stancelake.plans.queries import ORACLE_SQL, QUERIES
from tests.compare import duck_rows, spark_rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    names, rows = spark_rows(QUERIES[name](spark, DATA))
    want_names, want = duck_rows(ORACLE_SQL[name], DATA)
    assert names == want_names
    assert len(rows) == len(want)
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
