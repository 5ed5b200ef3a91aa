import duckdb
import pytest

import __spark_entry__ as entry
import check
from gradeframe.catalog.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return con


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_every_query_has_its_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, con, data, name):
    result, _ = check.compare(spark, con, name, data)
    assert result.startswith("ok"), result
