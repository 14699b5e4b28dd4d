"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as contract
from compare import connect, difference

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, sf_dir, db, name):
    df = contract.queries()[name](spark, sf_dir)
    if name in SQL:
        assert difference(df, db, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
