"""Every registered query against its SQL in DuckDB, at the smallest scale."""
import pytest

from __spark_entry__ import oracle_sql, queries
from check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    outcome, _, detail = compare(spark, con, SF, name, queries()[name], ORACLES.get(name))
    assert outcome.startswith(("ok", "rows")), (outcome, detail)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())
