import pytest

from gridloom.plans import oracles, queries
from tests.compare import DATA, check

Q, SQL = queries.queries(), oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    check(spark, name, Q[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_query_runs(spark, name):
    assert Q[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 100
