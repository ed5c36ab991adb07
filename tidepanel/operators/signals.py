"""Change signals: log growth or residuals with the common movement removed.

Rows are (scenario keys…, id, m, z); the scenario keys let one plan score many altered panels.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidepanel.functions import scalars
from tidepanel.operators import joins, prep, profiles
from tidepanel.operators.quantiles import bounded_median, grouped_median
from tidepanel.session import cut_lineage


def yoy_of_series(s: DataFrame, keys: list[str], last: int | None = None) -> DataFrame:
    """(keys, id, m, growth) from rows that already hold the array of an id."""
    stop = F.col("start") + F.size("vals") - 1 if last is None else F.lit(last)
    rows = s.filter(F.col("start") + 12 <= stop).select(*keys, "id", "start", "vals", F.explode(F.sequence(F.col("start") + 12, stop)).alias("m"))
    return rows.select(*keys, "id", "m", scalars.log_ratio(prep.at("m"), prep.at(F.col("m") - 12)).alias("growth"))


def yoy_log(panel: DataFrame, keys: list[str] | None = None, last: int | None = None) -> DataFrame:
    """(keys, id, m, growth): ln of the value over its value twelve months before, NULL when unknown."""
    keys = keys or []
    return yoy_of_series(prep.series(panel, [*keys, "id"]), keys, last)


def _remove_common(growth: DataFrame, keys: list[str]) -> DataFrame:
    growth = cut_lineage(growth, "growth")
    common = grouped_median(growth, [*keys, "m"], "growth", "_common").drop("n")
    return growth.join(common, [*keys, "m"], "left").withColumn("z", F.col("growth") - F.col("_common")).drop("_common")


def signal_yoy_level(growth: DataFrame, cal: tuple[int, int], keys: list[str] | None = None, parts: bool = False) -> DataFrame:
    """Growth minus the panel median of the month minus the id's own calibration median; with ``parts`` also growth and that median."""
    keys = keys or []
    centred = _remove_common(growth, keys)
    # One id and scenario per window: as many rows as months, and the scores that follow group by the same keys.
    own = F.percentile(F.when(F.col("m").between(*cal), F.col("z")), 0.5).over(W.partitionBy(*keys, "id"))
    return centred.withColumn("_base", own).filter("_base is not null").select(
        *keys, "id", "m", (F.col("z") - F.col("_base")).alias("z"), *(["growth", F.col("_base").alias("base")] if parts else []))


def signal_yoy_linear(growth: DataFrame, cal: tuple[int, int], keys: list[str] | None = None) -> DataFrame:
    """As above with the calibration least-squares line of the id removed instead of its median."""
    keys = keys or []
    centred = _remove_common(growth, keys)
    t = (F.col("m") - cal[0]).cast("double")
    line = centred.filter(F.col("m").between(*cal)).groupBy(*keys, "id").agg(
        F.regr_slope(F.col("z"), t).alias("_b"), F.regr_intercept(F.col("z"), t).alias("_a"))
    return centred.join(line, [*keys, "id"]).select(*keys, "id", "m", (F.col("z") - F.col("_a") - F.col("_b") * t).alias("z"))


def signal_levels(growth: DataFrame, regions: DataFrame, minimum: int, keys: list[str] | None = None) -> DataFrame:
    """(level, unit, m, z): panel median, regional medians (enough ids), local minus regional."""
    keys = keys or []
    growth = cut_lineage(growth, "growth")
    sizes = growth.select(*keys, "id").distinct().join(regions.select("id", "region"), "id").filter("region is not null").groupBy(*keys, "region").agg(F.count("*").alias("_n"))
    eligible = sizes.filter(F.col("_n") >= minimum).select(*keys, "region")
    rows = growth.join(regions.select("id", "region"), "id").join(eligible, [*keys, "region"], "left_semi")
    regional = grouped_median(rows, [*keys, "region", "m"], "growth", "_r").drop("n")
    national = grouped_median(growth, [*keys, "m"], "growth", "z").drop("n")
    local = rows.join(regional, [*keys, "region", "m"]).select(*keys, F.lit("local").alias("level"), F.col("id").cast("string").alias("unit"), "m", (F.col("growth") - F.col("_r")).alias("z"))
    return (
        local.unionByName(regional.select(*keys, F.lit("regional").alias("level"), F.col("region").cast("string").alias("unit"), "m", F.col("_r").alias("z")))
        .unionByName(national.select(*keys, F.lit("national").alias("level"), F.lit("panel").alias("unit"), "m", "z")))


def forecast_residual(fc: DataFrame, min_peers: int = 5) -> DataFrame:
    """(id, m, own, peers, peer): ln(actual / predicted), and minus the peer median of the region."""
    own = fc.select("id", "region", F.col("target").alias("m"), scalars.log_ratio("actual", "predicted").alias("own"))
    out = joins.leave_one_out_median(own, ["region", "m"], "own", min_peers)
    return out.select("id", "region", "m", "own", "peers", "peer_median", (F.col("own") - F.col("peer_median")).alias("peer"))


def signal_deseasonal_level(panel: DataFrame, year: int) -> DataFrame:
    """ln value − ln pooled profile."""
    rows = panel.crossJoin(F.broadcast(profiles.profile_global(panel, year)))
    return rows.select("id", "m", (F.log(scalars.positive_or_null("value")) - F.log(profiles.factor("p_global", "m"))).alias("z"))


def signal_relative_yoy(growth: DataFrame, regions: DataFrame, cal: tuple[int, int], min_peers: int = 5) -> DataFrame:
    """Growth minus the regional peer median, centred on the calibration median; ids with a gap there drop out."""
    rows = joins.leave_one_out_median(growth.join(regions.select("id", "region"), "id", "left"), ["region", "m"], "growth", min_peers)
    rows = rows.withColumn("z", F.col("growth") - F.col("peer_median"))
    months_needed = cal[1] - cal[0] + 1
    base = rows.filter(F.col("m").between(*cal)).groupBy("id").agg(F.count("z").alias("_n"), bounded_median("z").alias("_base")).filter(F.col("_n") == months_needed)
    return rows.join(base, "id").select("id", "m", (F.col("z") - F.col("_base")).alias("z"))


def noise_scale(signal: DataFrame, cal: tuple[int, int], weight: float, floor: float, keys: list[str] | None = None) -> DataFrame:
    """(id, mad, multiplier): pooled over mixed own and pooled deviation, calibration months only."""
    keys = keys or []
    inside = signal.filter(F.col("m").between(*cal) & F.col("z").isNotNull())
    center = inside.groupBy(*keys, "id").agg(bounded_median("z").alias("_c"))
    mad = inside.join(center, [*keys, "id"]).groupBy(*keys, "id").agg(bounded_median(F.abs(F.col("z") - F.col("_c"))).alias("mad"))
    pooled = grouped_median(mad, keys, "mad", "_p").drop("n").withColumn("_p", F.greatest("_p", F.lit(floor)))
    joined = mad.join(pooled, keys) if keys else mad.crossJoin(F.broadcast(pooled))
    mixed = F.greatest(weight * F.col("mad") + (1 - weight) * F.col("_p"), F.lit(floor))
    return joined.select(*keys, "id", "mad", (F.col("_p") / mixed).alias("multiplier"))


def prior_sigma(signal: DataFrame, cal: tuple[int, int], factor: float, floor: float) -> DataFrame:
    mad = noise_scale(signal, cal, 0.5, floor).select("mad")
    return grouped_median(mad, [], "mad", "_p").select(F.greatest(F.lit(factor) * F.col("_p"), F.lit(floor)).alias("sigma"))
