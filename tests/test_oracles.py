"""Registered queries give the same rows as their SQL on DuckDB.

A few of each kind run by default; ALL_ORACLES=1 runs every one, as does ``python check.py 0.01``.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


SOME = (
    "acceleration arrival_quality backtest_summary binary_metrics cascade_features components dedupe_answers exact_quantiles "
    "interval_deltas json_quarantine leak_check paired_intervals point_in_time popular_pool_topk post_feedback sealed_scores task_costs"
).split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_ORACLES") else SOME


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name):
    text, _ = check.compare(spark, connection, name, FOLDER)
    assert text.startswith("ok"), text


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
