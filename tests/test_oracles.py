"""Every registered query equals its DuckDB oracle (sf0.01, as the driver checks)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_CHECK
from tests.oracle import compare, duck

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    compare(E.queries()[name](spark, SF_CHECK), con, E.oracle_sql()[name])


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"split", "annotation", "n"}


def test_every_query_has_a_builder():
    assert set(E.oracle_sql()) <= set(E.queries())
