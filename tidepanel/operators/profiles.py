"""Seasonal profiles: twelve positive factors with mean 1, global, per region, mixed or shrunk.

A profile is a 12-element array so that it joins once per id or region, never per forecast row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions import months, scalars


def training_units(panel: DataFrame, year: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, train): the twelve profile-year values of every id complete in that year.

    One shuffle by id; nothing outside the year is read.
    """
    good = panel.filter(F.col("m").between(12 * year, 12 * year + 11)).withColumn(
        "value", scalars.positive_or_null("value")).filter("value is not null")
    grouped = good.groupBy(*(keys or []), "id").agg(F.sort_array(F.collect_list(F.struct("m", "value"))).alias("_s"))
    return grouped.filter(F.size("_s") == 12).select(*(keys or []), "id", F.transform("_s", lambda x: x["value"]).alias("train"))


def units_of_series(s: DataFrame, year: int, keys: list[str] | None = None) -> DataFrame:
    """``training_units`` of rows that already hold the array of an id: nothing is aggregated again."""
    first = 12 * year
    inside = s.filter((F.col("start") <= first) & (F.col("stop") >= first + 11))
    inside = inside.select(*(keys or []), "id", F.slice("vals", F.lit(first + 1) - F.col("start"), 12).alias("train"))
    return inside.filter(~F.exists("train", lambda x: F.coalesce(x <= 0, F.lit(True))))


def training_rows(panel: DataFrame | None, year: int, keys: list[str] | None = None, units: DataFrame | None = None) -> DataFrame:
    """Rows of ``units``, or of those of the panel."""
    units = training_units(panel, year, keys) if units is None else units
    return units.select(*(keys or []), "id", F.posexplode("train").alias("moy", "value"))


def _as_array(sums: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sums per month of year → normalised array; groups here hold exactly twelve rows."""
    entry = F.sort_array(F.collect_list(F.struct("moy", "total")))
    grouped = sums.groupBy(*keys).agg(F.transform(entry, lambda s: s["total"]).alias("_t"), F.avg("total").alias("_mean"))
    return grouped.select(*keys, F.transform("_t", lambda x: x / F.col("_mean")).alias(name))


def profile_global(panel: DataFrame | None, year: int, keys: list[str] | None = None, name: str = "p_global", units: DataFrame | None = None) -> DataFrame:
    keys = keys or []
    sums = training_rows(panel, year, keys, units).groupBy(*keys, "moy").agg(F.sum("value").alias("total"))
    return _as_array(sums, keys, name)


def profile_regional(panel: DataFrame | None, regions: DataFrame, year: int, minimum: int, keys: list[str] | None = None, units: DataFrame | None = None) -> DataFrame:
    """(region, members, p_region) for regions with at least ``minimum`` eligible ids."""
    keys = keys or []
    rows = training_rows(panel, year, keys, units).join(regions.select("id", "region"), "id").filter("region is not null")
    # Every eligible id has twelve rows, one per month, so the month count is the member count.
    sums = rows.groupBy(*keys, "region", "moy").agg(F.sum("value").alias("total"), F.count("*").alias("_n"))
    members = sums.groupBy(*keys, "region").agg(F.max("_n").alias("members")).filter(F.col("members") >= minimum)
    return _as_array(sums, [*keys, "region"], "p_region").join(members, [*keys, "region"])


def mix(p_global, p_region, weight) -> Column:
    """(1 − w) · global + w · regional; without a regional profile the global one stands."""
    g, r = F.col(p_global), F.coalesce(F.col(p_region), F.col(p_global))
    return F.zip_with(g, r, lambda a, b: (1 - F.lit(weight)) * a + F.lit(weight) * b)


def profile_mix(panel: DataFrame | None, regions: DataFrame, year: int, minimum: int, weight: float, units: DataFrame | None = None) -> DataFrame:
    """(id, region, profile, regional_profile_used) for every eligible id."""
    units = training_units(panel, year) if units is None else units
    ids = units.select("id").join(regions.select("id", "region"), "id", "left")
    regional = profile_regional(panel, regions, year, minimum, units=units)
    joined = ids.join(regional, "region", "left").crossJoin(F.broadcast(profile_global(panel, year, units=units)))
    return joined.select(
        "id", "region", mix("p_global", "p_region", weight).alias("profile"),
        F.col("p_region").isNotNull().alias("regional_profile_used"))


def shrink_weight(members, k: float | None) -> Column:
    """n / (n + k); None keeps the global profile."""
    return F.lit(0.0) if k is None else F.col(members) / (F.col(members) + F.lit(float(k)))


def geometric(p_global, p_region, weight: Column) -> Column:
    """exp(w·ln regional + (1−w)·ln global), factor by factor."""
    r = F.coalesce(F.col(p_region), F.col(p_global))
    return F.zip_with(F.col(p_global), r, lambda a, b: F.exp(weight * F.log(b) + (1 - weight) * F.log(a)))


def profile_shrunk(panel: DataFrame, regions: DataFrame, year: int, minimum: int, k: float | None) -> DataFrame:
    ids = training_units(panel, year).select("id").join(regions.select("id", "region"), "id", "left")
    regional = profile_regional(panel, regions, year, minimum)
    w = F.coalesce(shrink_weight("members", k), F.lit(0.0))
    return ids.join(regional, "region", "left").crossJoin(F.broadcast(profile_global(panel, year))).select(
        "id", "region", geometric("p_global", "p_region", w).alias("profile"))


def factor(profile, m) -> Column:
    m = F.col(m) if isinstance(m, str) else m
    profile = F.col(profile) if isinstance(profile, str) else profile
    return F.get(profile, months.month_of_year(m))


def bridge(level, profile, origin, horizon, rate) -> Column:
    """level · p[target] / p[origin] · (1 + g)^k with k calendar-year crossings."""
    level = F.col(level) if isinstance(level, str) else level
    origin, horizon = F.col(origin), F.col(horizon)
    ratio = factor(profile, origin + horizon) / factor(profile, origin)
    base = F.lit(1.0) + (F.col(rate) if isinstance(rate, str) else F.lit(float(rate)) if not isinstance(rate, Column) else rate)
    return level * ratio * F.pow(base, months.year_bridges(origin, horizon))


def to_rows(df: DataFrame, keys: list[str], profile: str) -> DataFrame:
    return df.select(*keys, F.posexplode(profile).alias("moy", "factor"))
