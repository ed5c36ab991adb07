"""Inputs shared by the registered queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.catalog.kit import FIRST, GROWTH, HORIZONS, MIN_REGION, WEIGHT, YEAR
from tidepanel.operators import forecast, profiles
from tidepanel.sources import tables


def base_forecasts(spark: SparkSession, sf_dir: str, models: list[str] | None = None, horizons=HORIZONS) -> DataFrame:
    return forecast.rolling_origin(
        tables.supplier_panel(spark, sf_dir), tables.supplier_lookup(spark, sf_dir), YEAR, horizons,
        weight=WEIGHT, minimum=MIN_REGION, growth=GROWTH, models=models)


def mixed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile_mix(
        tables.supplier_panel(spark, sf_dir), tables.supplier_lookup(spark, sf_dir), YEAR, MIN_REGION, WEIGHT)
