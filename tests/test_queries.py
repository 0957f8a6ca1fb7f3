"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests import oracle

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, small, con, name):
    run = contract.queries()[name]
    if name in SQL:
        said = oracle.compare(spark, run, SQL[name], con, small)
        if said == "both empty":
            larger = "/root/testdata/sf0.01"
            said = oracle.compare(spark, run, SQL[name], oracle.connect(larger), larger)
        assert said == ""
    else:
        assert run(spark, small).count() > 0


def test_entry(spark):
    result = contract.entry(spark)
    assert result.count() == 6 and "r2" in result.columns
