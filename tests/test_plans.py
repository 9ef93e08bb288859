"""What the plans must look like: filters and columns at the scan, no joins of everything with everything, no Python."""

import os
import re

import pytest

from ravelin.plans import all_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
WINDOWS = ["congestion_counts", "arrival_taxi_in_ctx", "dep_rate_30m", "recent_delay", "queue_weighted", "overdue_gate", "surface_counts", "ewma_rate", "runway_config", "stand_last_arrival_asof", "nearest_asof_cascade", "band_match", "ground_segments", "ref_p10_fallback", "cell_stats_fallback", "group_zscore", "gain_decomposition"]


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_range_scans_push_filter_and_columns(spark):
    text = plan(all_queries()["time_range_scan"](spark, DATA))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate.*LessThanOrEqual\(o_orderdate", text)
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>", text)


@pytest.mark.parametrize("name", WINDOWS)
def test_window_queries_stay_in_the_engine(spark, name):
    text = plan(all_queries()[name](spark, DATA))
    assert "props" not in text
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas|Arrow", text)


@pytest.mark.parametrize("name", ["dep_rate_30m", "overdue_gate", "surface_counts", "stand_last_arrival_asof"])
def test_groups_are_spread_over_time_buckets(spark, name):
    """Every window over raw rows is partitioned by a bucket besides the group."""
    text = plan(all_queries()[name](spark, DATA))
    assert "Window" in text and re.search(r"hashpartitioning\(airport#\d+.*?, __b#\d+", text)
