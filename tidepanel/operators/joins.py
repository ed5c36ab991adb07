"""Joins with a stated cardinality or a time condition."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepanel.functions import months, scalars
from tidepanel.operators import guards
from tidepanel.operators.quantiles import bounded_median, grouped_median, peer_medians, without_own
from tidepanel.schema import FORECAST_KEYS
from tidepanel.session import cut_lineage


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], cardinality: str, how: str = "inner") -> DataFrame:
    """``1:1`` or ``m:1`` equi join; a duplicated key on a side that must be unique stops the job. Each input is read once."""
    if cardinality not in ("1:1", "m:1"):
        raise ValueError("cardinality must be 1:1 or m:1")
    if cardinality == "1:1":
        left = guards.require_unique(left, keys)
    return left.join(guards.require_unique(right, keys), keys, how)


def lookup_region(df: DataFrame, lookup: DataFrame, unmapped: str = "keep") -> DataFrame:
    out = df.join(lookup.select("id", "region"), "id", "left")
    if unmapped == "reject":
        guards.assert_empty(out.filter("region is null"), "id without region")
    return out


def year_ago_join(panel: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Self join at m − 12 by value of the month, so a gap never shifts the match."""
    before = panel.select(*keys, (F.col("m") + 12).alias("m"), *[F.col(c).alias(f"{c}_year_ago") for c in columns])
    return panel.join(before, [*keys, "m"])


def match_errors(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """Exact key equality, then error differences. Any one-sided key or differing actual stops the job."""
    left = guards.require_unique(candidate.select(*FORECAST_KEYS, "actual", "predicted"), FORECAST_KEYS)
    right = guards.require_unique(reference.select(
        *FORECAST_KEYS, F.col("actual").alias("reference_actual"), F.col("predicted").alias("reference_predicted")), FORECAST_KEYS)
    both = guards.require(left.join(right, FORECAST_KEYS, "full_outer"), F.col("actual") == F.col("reference_actual"), "keys or actuals differ")
    ae, ref = scalars.abs_error(), scalars.abs_error("reference_actual", "reference_predicted")
    return both.select(*FORECAST_KEYS, ref.alias("reference_ae"), ae.alias("candidate_ae"), (ae - ref).alias("difference"))


def match_frozen_keys(frozen: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh columns beside every frozen key; a key that fresh does not cover stops the job."""
    both = frozen.join(fresh.withColumn("_covered", F.lit(True)), keys, "left")
    return guards.require(both, F.col("_covered"), "frozen keys are not covered").drop("_covered")


def actual_mismatches(fc: DataFrame, panel: DataFrame) -> DataFrame:
    """Forecast rows whose actual is absent from the source or differs from it."""
    source = panel.select("id", F.col("m").alias("target"), F.col("value").alias("source_value"))
    return fc.join(source, ["id", "target"], "left").filter(~F.col("actual").eqNullSafe(F.col("source_value")))


def effective_dated(facts: DataFrame, dimension: DataFrame, key: str, moment: str, start: str = "valid_from", stop: str = "valid_to") -> DataFrame:
    """Dimension row with start ≤ moment < stop; facts without one are kept."""
    condition = (facts[key] == dimension[key]) & (facts[moment] >= dimension[start]) & (facts[moment] < dimension[stop])
    return facts.join(dimension, condition, "left").drop(dimension[key])


def asof_latest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Latest right row at or before each left row, without a range join.

    The search runs on the distinct (key, time) pairs of both sides, which the calendar bounds however
    hot a key is; left rows get their answer back by equality. Left rows without a match are kept.
    """
    ks = keys or ["_all"]
    l, r = (left, right) if keys else (left.withColumn("_all", F.lit(1)), right.withColumn("_all", F.lit(1)))
    asked = l.select(*ks, F.col(left_time).alias("_t")).distinct().withColumn("_side", F.lit(1))
    known = r.groupBy(*ks, F.col(right_time).alias("_t")).agg(F.max(F.struct(*values)).alias("_r")).withColumn("_side", F.lit(0))
    line = asked.unionByName(known, allowMissingColumns=True)
    w = W.partitionBy(*ks).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = line.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    answers = seen.select(*ks, F.col("_t").alias(left_time), *[F.col(f"_last.{c}").alias(c) for c in values])
    out = l.join(answers, [*ks, left_time], "left")
    return out if keys else out.drop("_all")


def k_nearest(edges: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, neighbor, distance, rank) of the k nearest eligible ids, by distance then id.

    Edges are symmetrised and reduced to the least distance per pair first; the rank filter is applied
    before the shuffle as well, so a hub sends k rows per task rather than all its edges.
    """
    clean = edges.filter("id_x <> id_y and distance >= 0").filter(scalars.finite_or_null("distance").isNotNull())
    both = clean.select("id_x", "id_y", "distance").unionByName(
        clean.select(F.col("id_y").alias("id_x"), F.col("id_x").alias("id_y"), "distance"))
    pool = ids.select("id")
    both = both.join(pool.withColumnRenamed("id", "id_x"), "id_x", "left_semi").join(pool.withColumnRenamed("id", "id_y"), "id_y", "left_semi")
    pairs = both.groupBy(F.col("id_x").alias("id"), F.col("id_y").alias("neighbor")).agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbor"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearby_excluding(edges: DataFrame, cases: DataFrame, signal: DataFrame, radius: float, k: int) -> DataFrame:
    """Per case (id, paired): median signal of its nearest k ids within the radius, the paired id left out."""
    near = edges.filter(F.col("distance") <= radius)
    both = near.select("id_x", "id_y", "distance").unionByName(
        near.select(F.col("id_y").alias("id_x"), F.col("id_x").alias("id_y"), "distance"))
    links = both.filter("id_x <> id_y").groupBy(F.col("id_x").alias("id"), F.col("id_y").alias("neighbor")).agg(F.min("distance").alias("distance"))
    links = links.join(cases, "id").filter("neighbor <> paired").join(signal.select(F.col("id").alias("neighbor"), "signal"), "neighbor")
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbor"))
    return links.withColumn("_k", rank).filter(F.col("_k") <= k).groupBy("id", "paired").agg(
        bounded_median("signal").alias("neighbor_median"), F.count("*").alias("neighbors"))


def neighbor_features(panel: DataFrame, neighbors: DataFrame, k: int, spike: float = 0.15) -> DataFrame:
    """(id, m): mean neighbour growth at m and m − 1, share of lagged spikes, share of valid neighbours."""
    now = panel.select("id", "m", scalars.positive_or_null("value").alias("value")).filter("value is not null")
    before = now.select("id", (F.col("m") + 1).alias("m"), F.col("value").alias("previous"))
    growth = now.join(before, ["id", "m"]).select(F.col("id").alias("neighbor"), "m", F.log(F.col("value") / F.col("previous")).alias("g"))
    both = growth.select("neighbor", "m", F.col("g").alias("current"), F.lit(None).cast("double").alias("past")).unionByName(
        growth.select("neighbor", (F.col("m") + 1).alias("m"), F.lit(None).cast("double").alias("current"), F.col("g").alias("past")))
    return neighbors.select("id", "neighbor").join(both, "neighbor").groupBy("id", "m").agg(
        F.avg("current").alias("neighbor_growth"), F.avg("past").alias("neighbor_growth_lag"),
        F.avg((F.abs("past") > spike).cast("double")).alias("neighbor_spikes"),
        (F.count("current") / F.lit(float(k))).alias("neighbor_valid"))


def leave_one_out_median(df: DataFrame, group: list[str], value: str, min_peers: int) -> DataFrame:
    """Peer count and peer median without the row itself; NULL below ``min_peers`` or without a group."""
    df = cut_lineage(df, "peers")
    stats = peer_medians(df.filter(" and ".join(f"{g} is not null" for g in group)), group, value)
    joined = df.join(stats, group, "left")
    peers = F.coalesce(F.col("_n"), F.lit(0)) - F.col(value).isNotNull().cast("int")
    peers = F.greatest(peers, F.lit(0))
    return joined.withColumn("peers", peers).withColumn(
        "peer_median", F.when(peers >= min_peers, without_own(value))).drop("_n", "_below", "_mid", "_above")


def scenario_cross(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Cross with a scenario table built from settings; its size is fixed by the settings."""
    return df.crossJoin(F.broadcast(scenarios))
