"""A cross-section of the registered queries against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
NAMES = ["flagship_explored_by_owner", "win1_steps", "joi1_assign_fixes", "agg6_street_states", "agg14_zone_completion",
         "src8_block_plans", "rew1_daily_tasks", "win6_drawable_lines"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = entry_point.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry_point.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_statement_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
