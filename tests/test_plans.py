"""The plans are the ones wanted: pushed filters, pruned columns, no needless shuffle, partial aggregation."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratascan.functions import bloom, encodings
from stratascan.operators import stats
from stratascan.plans import catalog
from stratascan.sources import footers, scan

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return re.findall(r"ReadSchema: struct<(.*?)>\n?", text)


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(catalog.scan_filter_project(spark, str(DATA)))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in p
    assert "l_tax" not in p and "Exchange" not in p
    for op, name in {"eq": "EqualTo", "lt": "LessThan", "ge": "GreaterThanOrEqual", "ne": "Not(EqualTo"}.items():
        assert f"{name}(o_custkey,700)" in plan(catalog.QUERIES[f"filter_{op}"](spark, str(DATA)))


def test_counts_read_no_columns(spark):
    assert read_columns(plan(catalog.metadata_count(spark, str(DATA)))) == [""]


def test_row_numbers_need_no_shuffle(spark):
    events = scan.open_table(spark, f"{DATA}/events.parquet").select("event_id")
    for df in (scan.with_rows(events), scan.with_batches(scan.with_rows(events), 100), scan.read_rows(scan.with_rows(events), 10, 20)):
        assert "Exchange" not in plan(df)


def test_footers_read_no_contents(spark):
    p = plan(footers.footer_columns(spark, str(DATA)))
    assert "content" not in p and "Exchange" not in p


def test_aggregates_combine_before_the_shuffle(spark):
    events = scan.open_table(spark, f"{DATA}/events.parquet").withColumn("rg", F.floor(F.col("event_id") / 1000))
    assert "partial_min" in plan(stats.column_statistics(events, "value", ["rg"], distinct=None))
    built = plan(bloom.build(events, "event_id", 10))
    assert "partial_bit_or" in built and built.count("ArrowEvalPython") == 1
    p = plan(encodings.delta_encode(events, "user_id", "event_id", ["rg"]))
    assert p.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in p
