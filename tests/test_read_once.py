"""Inputs that cost a pass over the facts are evaluated once."""
import pytest

from tidepanel.operators import forecast, intervals


@pytest.fixture
def counted(spark):
    """A table and the number of its rows that were read so far."""

    def make(df):
        seen = spark.sparkContext.accumulator(0)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(count, df.schema), seen

    return make


def test_rolling_origin_reads_the_panel_once(spark, panel_of, counted):
    panel, seen = counted(panel_of({i: {m: 10.0 + i + m % 5 for m in range(24240, 24270)} for i in range(30)}))
    regions = spark.range(30).selectExpr("id", "id % 2 as region")
    forecast.rolling_origin(panel, regions, 2020, [1, 3], minimum=5).collect()
    assert seen.value == 30 * 30


def test_intervals_by_group_read_the_forecasts_once(spark, counted):
    fc, seen = counted(spark.createDataFrame([(i, t, float(i + t), float(i + t + i % 3)) for i in range(40) for t in range(8)], "id long, target int, actual double, predicted double"))
    groups = spark.range(40).selectExpr("id", "cast(id % 2 as string) as quartile")
    pairs = spark.createDataFrame([(t, t - 1) for t in range(1, 8)], "target int, cal_target int")
    out = intervals.calibrate_by_group(fc, groups, "quartile", pairs, "raw", 0.8).collect()
    assert len(out) == 40 * 7 and seen.value == 40 * 8
