"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_queries import compare, connect

from plancarta.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DIR)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_same_rows(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLE_SQL[name], DIR) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_runs(spark, name):
    df = QUERIES[name](spark, DIR)
    rows = df.limit(200).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
