"""Flagship plan: cutoffs → eligibility → profiles → anchors × horizons, one lazy plan plus its audit."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.functions import months, scalars
from tidepanel.operators import guards, prep, profiles
from tidepanel.schema import ForecastConfig


def known_history(panel: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Rows the decision may read: the category, up to the origin, public at the as-of date."""
    out = prep.exclude_future(panel, cfg.origin)
    if cfg.category is not None:
        out = out.filter(F.col("category") == cfg.category)
    if cfg.as_of is not None and "available_from" in panel.columns:
        out = out.filter(F.col("available_from") <= F.lit(cfg.as_of).cast("date"))
    return out


def validate(panel: DataFrame, lookup: DataFrame, cfg: ForecastConfig) -> None:
    """Reject bad input before anything is fitted; one aggregate per rule."""
    guards.require_columns(panel, ["id", "m", "value"])
    guards.require_columns(lookup, ["id", "region"])
    if cfg.growth_available_from is not None and cfg.as_of is not None and cfg.growth_available_from > cfg.as_of:
        raise ValueError("the growth source is not available at the as-of date")
    history = known_history(panel, cfg)
    if "available_from" in panel.columns:
        guards.assert_empty(
            prep.exclude_future(panel, cfg.origin).filter("available_from is null"),
            "available_from must be set for every historical row")
    guards.assert_empty(guards.bad_ids(history), "id: nonnegative integers required")
    guards.assert_unique(history, ["id", "m"])
    guards.assert_unique(lookup, ["id"])
    if history.filter(F.col("m") == cfg.origin).limit(1).count() == 0:
        raise ValueError("no available values at the origin")


def forecast_panel(panel: DataFrame, lookup: DataFrame, cfg: ForecastConfig) -> DataFrame:
    history = known_history(panel, cfg)
    prof = profiles.profile_mix(history, lookup, cfg.profile_year, cfg.minimum_region, cfg.region_weight)
    anchors = history.filter(F.col("m") == cfg.origin).select(
        "id", scalars.positive_or_null("value").alias("origin_value")).filter("origin_value is not null")
    hs = F.explode(F.array(*[F.lit(h) for h in cfg.horizons]))
    rows = anchors.join(prof, "id").withColumn("origin", F.lit(cfg.origin)).withColumn("horizon", hs)
    return rows.select(
        "id", "region", "origin", months.target_month("origin", "horizon").alias("target"), "horizon", "origin_value",
        profiles.bridge("origin_value", "profile", "origin", "horizon", cfg.growth_rate).alias("predicted"),
        "regional_profile_used")


def audit_counts(panel: DataFrame, forecasts: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """What was excluded, eligible, forecast and served by the global fallback."""
    base = panel if cfg.category is None else panel.filter(F.col("category") == cfg.category)
    future = F.col("m") > cfg.origin
    late = ~future & (F.col("available_from") > F.lit(cfg.as_of).cast("date")) if (
        cfg.as_of is not None and "available_from" in panel.columns) else F.lit(False)
    kept = ~future & ~late
    counts = base.agg(
        F.count(F.when(future, 1)).alias("future_rows_excluded"),
        F.count(F.when(late, 1)).alias("unavailable_rows_excluded"),
        F.count_distinct(F.when(kept, F.col("id"))).alias("input_ids"))
    eligible = prep.cohort_complete(known_history(panel, cfg), cfg.profile_year).agg(F.count("*").alias("profile_eligible_ids"))
    made = forecasts.agg(
        F.count_distinct("id").alias("forecast_ids"),
        F.count(F.when(~F.col("regional_profile_used"), 1)).alias("global_fallback_forecasts"))
    return counts.crossJoin(F.broadcast(eligible)).crossJoin(F.broadcast(made)).withColumn(
        "ids_without_forecast", F.col("input_ids") - F.col("forecast_ids"))
