import duckdb
import pytest
from conftest import DATA

from dupeframe.catalog.oracles import ORACLES
from dupeframe.catalog.queries import REGISTRY
from verify import TABLES, compare


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, con, name):
    problem = compare(spark, con, DATA, name, REGISTRY[name], ORACLES[name])
    assert problem in (None, "no rows on either side")


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 21
