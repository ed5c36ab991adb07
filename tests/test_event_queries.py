"""Queries of event matching, from ids and from counted paths."""
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from check_oracle import compare, connect
from tidepanel.catalog import monitoring
from tidepanel.operators import backtest, detectors

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")
@pytest.mark.parametrize("name", ["match_events", "event_scores", "choose_detector", "recheck_detector_table"])
def test_event_queries_equal_sql(spark, name):
    status, _, _, note = compare(spark, connect(SF), name, SF)
    assert status == "ok", note


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")
def test_counted_paths_are_scored_like_their_units(spark):
    ids, counts = monitoring.matched(spark, SF), monitoring.matched(spark, SF, backtest.path_counts)
    assert "id" in ids.columns and "n" in counts.columns and counts.agg(F.sum("n")).first()[0] == ids.count()
    read = lambda rows: sorted(map(repr, detectors.event_scores(rows, ["split", "method"], 6).collect()))
    assert read(ids) == read(counts)
