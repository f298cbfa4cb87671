"""Every registered query, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf_dir, name):
    assert compare(spark, duck, name, QUERIES[name], SQL.get(name), sf_dir) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "timestamp_ms"


def test_any_session_time_zone(spark, duck, sf_dir):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for name in ("filter_time_range", "table_render", "summary_row", "store_scan"):
            assert compare(spark, duck, name, QUERIES[name], SQL[name], sf_dir) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
