"""Every registered query runs; those with SQL give the same rows and types as DuckDB."""

import pytest

import __spark_entry__ as entry
from conftest import SF
from oracle import connect, differences

# the training-data subpackage has its own tests
OWN = entry.registry.QUERIES
SQL = entry.registry.SQL


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert differences(OWN[name](spark, SF), duck, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_runs(spark, name, tmp_path):
    OWN[name](spark, SF).write.parquet(str(tmp_path / "out"))


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(OWN) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
