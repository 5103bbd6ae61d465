"""Every registered query against its DuckDB twin: names, types and all values."""

import pytest

import __spark_entry__ as contract
from fixtures.compare import differences, duck
from fixtures.queries import QUERIES

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    ours = contract.queries()[name](spark, sf_dir).toArrow()
    assert ours.num_rows > 0
    assert differences(ours, con.execute(SQL[name]).to_arrow_table()) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
