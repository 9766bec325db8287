"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET memory_limit='6GB'; SET max_temp_directory_size='2GB'")
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 171


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    verdict = compare.compare(spark, con, name, SF)
    assert verdict.startswith("ok" if name in entry.oracle_sql() else "rows"), verdict
