"""Registered queries against their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import duckdb

import __spark_entry__ as entry
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
# One or two of every family; tools/check.py runs all of them.
CHECKED = ("val01_line_item_total", "val11_verdicts", "val18_data_rules", "agg01_key_metrics", "agg06_geographic_distribution",
           "agg17_value_statistics", "agg19_quarterly_breakdown", "win01_growth", "win02_supplier_performance", "prj10_search_invoices",
           "jn08_amount_within_1000", "jn09_amount_within_one_percent", "jn10_shared_hsn", "dup05_candidate_union",
           "dup12_exact_matches", "cls07_decision", "txt02_intent", "reg03_recommendations", "rsk02_reasoning_confidence",
           "bat01_batch_summary", "ext07_line_items", "pag03_return_filings", "nst02_form_fields", "str04_session_activity")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    answer = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, answer.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
