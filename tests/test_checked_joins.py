"""Checks inside the plan: nothing runs while it is built, each input is read once, and bad rows stop the job."""
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import joins, selection

KEYS = "id long, origin int, target int, horizon int, actual double, predicted double"


def forecasts(spark, rows):
    return spark.createDataFrame(rows, KEYS)


@pytest.fixture
def counted(spark):
    """A table whose rows are counted as they are read."""
    def make(df, name):
        seen = spark.sparkContext.accumulator(0)

        def read(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(read, df.schema), seen

    return make


GOOD = [(i, 0, h, h, 10.0 * i, 9.0 * i) for i in range(1, 30) for h in (1, 3)]


def test_nothing_runs_before_and_each_input_is_read_once(spark, counted):
    left, seen_left = counted(forecasts(spark, GOOD), "left")
    right, seen_right = counted(forecasts(spark, GOOD), "right")
    frames = [joins.match_errors(left, right), joins.match_frozen_keys(left, right.drop("actual", "predicted"), ["id", "origin", "target", "horizon"]),
              joins.join_checked(left, right.select("id", "horizon", F.col("predicted").alias("p")), ["id", "horizon"], "1:1"), selection.compare_releases(left, right)]
    assert seen_left.value == seen_right.value == 0
    for n, frame in enumerate(frames, 1):
        assert len(frame.collect()) == len(GOOD)
        assert seen_left.value == seen_right.value == n * len(GOOD)


@pytest.mark.parametrize("make, message", [
    (lambda s: joins.match_errors(forecasts(s, GOOD + GOOD[:1]), forecasts(s, GOOD)), "duplicate"),
    (lambda s: joins.match_errors(forecasts(s, GOOD), forecasts(s, GOOD + GOOD[-1:])), "duplicate"),
    (lambda s: joins.match_errors(forecasts(s, GOOD[1:]), forecasts(s, GOOD)), "differ"),
    (lambda s: joins.match_errors(forecasts(s, GOOD), forecasts(s, GOOD[:-1])), "differ"),
    (lambda s: joins.match_errors(forecasts(s, GOOD), forecasts(s, GOOD[:-1] + [(*GOOD[-1][:4], 1.0, 2.0)])), "differ"),
    (lambda s: joins.match_frozen_keys(forecasts(s, GOOD), forecasts(s, GOOD[1:]).select("id", "horizon"), ["id", "horizon"]), "not covered"),
    (lambda s: joins.join_checked(forecasts(s, GOOD), forecasts(s, GOOD).select("id", F.lit(1).alias("x")), ["id"], "m:1"), "duplicate"),
    (lambda s: joins.join_checked(forecasts(s, GOOD), forecasts(s, GOOD).select("id").distinct().withColumn("x", F.lit(1)), ["id"], "1:1"), "duplicate")])
def test_bad_rows_stop_the_job(spark, make, message):
    frame = make(spark)
    with pytest.raises(Exception, match=message):
        frame.collect()


def test_a_repeated_key_of_the_many_side_is_no_error(spark):
    assert joins.join_checked(forecasts(spark, GOOD), forecasts(spark, GOOD).select("id").distinct().withColumn("x", F.lit(1)), ["id"], "m:1").count() == len(GOOD)
    with pytest.raises(ValueError):
        joins.join_checked(forecasts(spark, GOOD), forecasts(spark, GOOD), ["id"], "1:n")
