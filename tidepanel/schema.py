"""Column contracts shared by every operator, and validated settings."""
from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

from pyspark.sql import types as T

OBSERVATION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("month", T.DateType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("available_from", T.DateType()),
])
LOOKUP = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("region", T.LongType()),
    T.StructField("name", T.StringType()),
])
EDGES = T.StructType([
    T.StructField("id_x", T.LongType()),
    T.StructField("id_y", T.LongType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("type", T.StringType()),
])
FORECAST_KEYS = ["id", "origin", "target", "horizon"]


def _number(value, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number")
    return float(value)


def whole(value, name: str, minimum: int = 1) -> int:
    if _number(value, name) != int(value) or value < minimum:
        raise ValueError(f"{name} must be an integer of at least {minimum}")
    return int(value)


def growth(value, name: str = "growth_rate") -> float:
    if _number(value, name) <= -1:
        raise ValueError(f"{name} must exceed -1")
    return float(value)


def share(value, name: str = "weight") -> float:
    if not 0 <= _number(value, name) <= 1:
        raise ValueError(f"{name} must lie between 0 and 1")
    return float(value)


@dataclass(frozen=True)
class ForecastConfig:
    """Everything the forecast plan needs; months are indices (see functions.months)."""

    origin: int
    profile_year: int
    horizons: tuple[int, ...]
    growth_rate: float = 0.0
    region_weight: float = 0.5
    minimum_region: int = 10
    category: str | None = None
    as_of: str | None = None
    growth_available_from: str | None = None
    geography_year: int | None = None

    def __post_init__(self):
        whole(self.origin, "origin")
        whole(self.profile_year, "profile_year")
        if self.profile_year * 12 + 11 > self.origin:
            raise ValueError("the profile year must be complete at the origin")
        hs = [whole(h, "horizon") for h in self.horizons]
        if not hs or len(set(hs)) != len(hs):
            raise ValueError("horizons must be unique and non-empty")
        growth(self.growth_rate)
        share(self.region_weight, "region_weight")
        whole(self.minimum_region, "minimum_region")
        if self.geography_year is not None and whole(self.geography_year, "geography_year") > self.origin // 12:
            raise ValueError("geography_year must not be later than the origin")


@dataclass(frozen=True)
class DetectorSettings:
    # The documented detector defaults.
    ewma_alpha: float = 0.45
    cusum_drift: float = 0.025
    noise_individual_weight: float = 0.5
    noise_floor: float = 0.0001
    threshold_quantile: float = 0.99
    bocpd_hazard: float = 1 / 12
    bocpd_mu: float = 0.0
    bocpd_kappa: float = 1.0
    bocpd_alpha: float = 2.0
    bocpd_sigma_floor: float = 0.02
    bocpd_mad_factor: float = 1.4826

    def __post_init__(self):
        for f in fields(self):
            _number(getattr(self, f.name), f.name)
        for name in ("ewma_alpha", "noise_individual_weight", "threshold_quantile", "bocpd_hazard"):
            if not 0 < getattr(self, name) < 1:
                raise ValueError(f"{name} must lie strictly between 0 and 1")
        for name in ("noise_floor", "bocpd_kappa", "bocpd_sigma_floor", "bocpd_mad_factor"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.cusum_drift < 0 or self.bocpd_alpha <= 1:
            raise ValueError("cusum_drift must be nonnegative and bocpd_alpha greater than 1")

    @classmethod
    def from_mapping(cls, settings: dict) -> "DetectorSettings":
        if not isinstance(settings, dict) or set(settings) != {f.name for f in fields(cls)}:
            raise ValueError("detector settings must contain exactly the documented keys")
        return cls(**settings)
