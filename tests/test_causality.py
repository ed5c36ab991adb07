"""Changing every value after the cutoff must not change anything known at the cutoff."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators.boosting import Boost
from tidepanel.operators import backtest, detectors, forecast, joins, learned, prep, profiles, selection, signals, trend
from tidepanel.plans.forecast_panel import forecast_panel
from tidepanel.schema import ForecastConfig

FIRST, CUT, LAST = 12 * 2020, 12 * 2021 + 11, 12 * 2022 + 11


@pytest.fixture(scope="module")
def panels(spark):
    rng = np.random.default_rng(9)
    rows = [(i, m, float(100 * (1 + i % 3) * (1 + 0.2 * np.sin(m)) * rng.lognormal(0, 0.1))) for i in range(24) for m in range(FIRST, LAST + 1) if rng.random() > 0.02 or m < CUT - 3]
    before = spark.createDataFrame(rows, "id long, m int, value double").cache()
    after = before.withColumn("value", F.when(F.col("m") > CUT, F.col("value") * (5 + F.col("id"))).otherwise(F.col("value"))).filter((F.col("m") <= CUT) | (F.col("id") % 4 != 0)).cache()
    return before, after, spark.createDataFrame([(i, i % 2) for i in range(24)], "id long, region long")


def assert_causal(op, panels, keep="true"):
    before, after, regions = panels
    frames = [sorted((tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in op(p, regions).filter(keep).collect()), key=str) for p in (before, after)]
    assert frames[0] and frames[0] == frames[1]


CFG = ForecastConfig(origin=CUT, profile_year=2020, horizons=(1, 3, 12), growth_rate=0.1, minimum_region=5)
KNOWN = f"origin <= {CUT}"
OPS = {
    "forecast_panel": (lambda p, r: forecast_panel(p, r, CFG), "true"),
    "profiles": (lambda p, r: profiles.profile_mix(p, r, 2020, 5, 0.5).select("id", "profile"), "true"),
    "cohort": (lambda p, r: prep.cohort_observed_through(p, FIRST, CUT - 4), "true"),
    "prefix": (lambda p, r: prep.prefix_complete(p, FIRST), KNOWN),
    "quartiles": (lambda p, r: prep.expense_quartiles(p, 2020), "true"),
    "growth_rate": (lambda p, r: forecast.regional_growth_rate(p, r, 2020, p.select(F.col("m").alias("origin")), 5, 0.1), KNOWN),
    "trend": (lambda p, r: trend.linear_trend(p, FIRST), KNOWN),
    "month_mean": (lambda p, r: forecast.month_mean_residual(p.filter(F.col("m") <= CUT), CUT - 6), "true"),
    "signal": (lambda p, r: signals.signal_yoy_level(signals.yoy_log(p), (FIRST + 12, FIRST + 17)), f"m <= {CUT}"),
    "levels": (lambda p, r: signals.signal_levels(signals.yoy_log(p), r, 5), f"m <= {CUT}"),
    "scores": (lambda p, r: detectors.scores(signals.signal_yoy_level(signals.yoy_log(p), (FIRST + 12, FIRST + 17)), ["id"]), f"m <= {CUT}"),
    "thresholds": (lambda p, r: detectors.threshold_unit_max(detectors.by_method(detectors.scores(signals.signal_yoy_level(signals.yoy_log(p), (FIRST + 12, FIRST + 17)), ["id"]), ["id"]), ["id"], (FIRST + 12, FIRST + 17), 0.99), "true"),
    "training_rows": (lambda p, r: learned.training_rows(p, FIRST, CUT, 3), "true"),
    "features": (lambda p, r: learned.context_features(p, r, CUT), "true"),
    "user_model": (lambda p, r: trend.forecast_with(p, [CUT], [1, 2], lambda h, n: np.repeat(h[:, -1:], n, axis=1), FIRST), "true"),
    "rolling": (lambda p, r: forecast.rolling_origin(p, r, 2020, [1, 3], minimum=5, models=["seasonal_mix", "growth_bridge", "seasonal_pooled"]), f"target <= {CUT}"),
    "bias": (lambda p, r: selection.bias_factors(forecast.rolling_origin(p, r, 2020, [1], models=["seasonal_local"]), "local", 3).select("origin", "id", "factor"), f"origin < {CUT}"),
}


@pytest.mark.parametrize("name", list(OPS))
def test_causal(panels, name):
    op, keep = OPS[name]
    assert_causal(op, panels, keep)


def test_learned_models_do_not_see_the_future(panels):
    before, after, regions = panels
    run = lambda p: sorted((r["id"], r["horizon"], round(r["predicted"], 9)) for r in learned.fit_recursive_growth(p, [CUT], 2, settings=Boost(3, least=20)).collect())
    assert run(before) == run(after)
    few = learned.fit_direct_horizon(before, regions, FIRST, [FIRST + 12], [11])
    assert {r["status"] for r in few.select("status").distinct().collect()} == {"seasonal_fallback"}


def test_injection_leaves_the_past_bit_equal(spark, panels):
    before, _, _ = panels
    shocked = backtest.inject_shock(before, backtest.scenario_table(spark, [1], [0.2], ["step", "ramp"]), CUT + 1)
    joined = shocked.join(before.withColumnRenamed("value", "old"), ["id", "m"])
    assert joined.filter((F.col("m") <= CUT) & (F.col("value") != F.col("old"))).count() == 0
    assert joined.filter(~F.col("treated") & (F.col("value") != F.col("old"))).count() == 0
    assert joined.filter(F.col("treated") & (F.col("m") == CUT + 2) & (F.col("value") == F.col("old"))).count() == 0
