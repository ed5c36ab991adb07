"""Back-test metrics from counts of equal paths, whatever the number of ids."""
from pyspark.sql import functions as F

from tidepanel.operators import backtest

FIRST, ONSET = 24000, 24036
CAL = (ONSET - 12, ONSET - 1)


def panel(spark, copies):
    noise = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("id") % 30, "m"), 256), 1, 6), 16, 10).cast("double") / 2**24
    rows = spark.range(30 * copies).select("id", F.explode(F.sequence(F.lit(FIRST), F.lit(ONSET + 5))).alias("m"))
    return rows.filter((F.col("id") % 7 != 3) | (F.col("m") != ONSET + 1)).select("id", F.col("m").cast("int").alias("m"), (100 + 40 * noise).alias("value"), (F.col("id") % 2).cast("string").alias("category"))


def metrics(rows):
    tables = (backtest.attribution_metrics(rows), backtest.observed_window_metrics(rows), backtest.calendar_delay_metrics(rows, [0, 1]), backtest.alarm_rates(rows))
    return [sorted(map(repr, (tuple(r) for r in t.select(sorted(t.columns)).collect()))) for t in tables]


def test_counts_of_paths_give_the_metrics_of_the_ids(spark):
    scenarios = backtest.scenario_table(spark, [1, 2], [-0.3, 0.3], ["step", "pulse", "ramp"], (0.25, 0.5))
    for options in ({}, {"group": ["category"], "lead": 2}, {"noise": (0.5, 0.0001)}):
        args = (panel(spark, 3), scenarios, ONSET, CAL)
        ids, counts = backtest.unit_paths(*args, **options).cache(), backtest.path_counts(*args, **options).cache()
        assert counts.agg(F.sum("n")).first()[0] == ids.count() == 24 * 5 * 90
        assert counts.count() < ids.count() and "id" not in counts.columns
        assert metrics(counts) == metrics(ids)
