"""Registered queries against their SQL on the smallest tables.

A cross-section runs by default; TIDEPANEL_ALL=1 runs every query.
"""
import os
from pathlib import Path

import pytest

from check_oracle import compare, connect
from tidepanel.catalog import load

SF = "/root/testdata/sf0.001"
SAMPLE = """forecast_panel evaluation_pairs export_nested rolling_origin ratio_shrunk fc_delayed regional_growth_rate fc_per_category trend_with_profile select_sequential_rolling_3m
bias_factor_local_3m asof_latest k_nearest neighbor_features leave_one_out_median accuracy_summary error_quantiles paired_stats leave_region_out leave_top5_out dm_test bootstrap_dates
intervals_rolling_3m intervals_by_group signal_yoy_level score_ewma score_cusum confirm_shift calendar_delay_metrics event_conditioned_threshold lead_table events_asof_features
parse_captures feed_items stream_aggregate stream_detect""".split()
QUERIES, ORACLES = load()
NAMES = list(ORACLES) if os.environ.get("TIDEPANEL_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    status, _, _, note = compare(spark, con, name, SF)
    assert status == "ok", note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
