"""Registered queries against their SQL oracles, one or two per group of operators.

`python tests/oracle.py` compares all of them at sf0.01.
"""

import os
import re

import pytest

import oracle
from meterframe.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

SAMPLE = [
    "bucket_day_sum",
    "bucket_month_last",
    "bucket_grouped",
    "bucket_grouped_nested",
    "filter_or_nested",
    "filter_bucket_nested_path",
    "breakdown_share",
    "subject_stats",
    "event_page_ties",
    "series_cumulative",
    "csv_events",
    "ingest_failed",
    "ingest_duplicates",
    "prune_dry_run",
    "meter_evolution",
    "scd2_assign",
    "period_windows",
    "usage_counters",
    "quota_check",
    "quota_transitions",
    "plan_preview_summary",
    "alert_states",
    "alert_backtest",
    "stream_tumbling_hour",
    "stream_ingest",
]


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert len(QUERIES) > 130


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, name):
    con = oracle.connect(FOLDER)
    assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], FOLDER) is None


def test_scan_filters_and_columns_reach_parquet(spark, capsys):
    """The bucket query reads only its columns and pushes meter and time range down."""
    QUERIES["bucket_day_sum"](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    schema = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert {part.split(":")[0] for part in schema.split(",")} == {"ts", "event_type", "value"}
    pushed = re.search(r"PushedFilters: (.*)", plan).group(1)
    assert "EqualTo(event_type,purchase)" in pushed and "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_small_sides_are_broadcast_and_events_are_not_shuffled_whole(spark, capsys):
    QUERIES["usage_counters"](spark, FOLDER).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SortMergeJoin"):
        assert bad not in plan
