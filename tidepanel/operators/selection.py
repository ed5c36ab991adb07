"""Blends and choices between models. Every choice reads only errors known at its own decision month."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepanel.functions import months, scalars
from tidepanel.schema import FORECAST_KEYS, share
from tidepanel.session import cut_lineage


def pair_models(fc: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """One row per key with both models side by side, by one aggregation instead of a self join.

    ``sides`` tells one-sided keys ("a", "b") from matched ones ("both"); ``same_actual`` must hold.
    """
    keys = keys or FORECAST_KEYS
    pick = lambda model, column: F.max(F.when(F.col("model") == model, F.col(column)))
    has = lambda model: F.max((F.col("model") == model).cast("int"))
    return (
        fc.filter(F.col("model").isin(a, b)).groupBy(*keys)
        .agg(pick(a, "actual").alias("actual_a"), pick(b, "actual").alias("actual_b"),
             pick(a, "predicted").alias("predicted_a"), pick(b, "predicted").alias("predicted_b"),
             has(a).alias("_a"), has(b).alias("_b"), F.count("*").alias("_n"))
        .withColumn("sides", F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both").when(F.col("_a") == 1, "a").otherwise("b"))
        .withColumn("same_actual", F.col("actual_a").eqNullSafe(F.col("actual_b")))
        .withColumn("duplicated", F.col("_n") > F.col("_a") + F.col("_b"))
        .drop("_a", "_b", "_n"))


def matched_pairs(fc: DataFrame, a: str, b: str, strict: bool = True) -> DataFrame:
    """Matched keys with losses; ``strict`` rejects one-sided keys, duplicates and differing actuals."""
    pairs = pair_models(fc, a, b)
    if strict:
        # Checked while the rows flow: no extra pass, and a bad key fails the job that reads it.
        bad = (F.col("sides") != "both") | ~F.col("same_actual") | F.col("duplicated")
        message = F.lit("models must cover the same keys once with the same actuals")
        pairs = pairs.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return pairs.filter("sides = 'both'").select(
        *FORECAST_KEYS, F.col("actual_a").alias("actual"), "predicted_a", "predicted_b",
        F.abs(F.col("actual_a") - F.col("predicted_a")).alias("loss_a"),
        F.abs(F.col("actual_b") - F.col("predicted_b")).alias("loss_b"))


def common_keys(fc: DataFrame, models: list[str], keys: list[str] | None = None, per: str = "model") -> DataFrame:
    """Rows whose key is present for every wanted value of ``per``."""
    keys = keys or FORECAST_KEYS
    full = fc.filter(F.col(per).isin(*models)).groupBy(*keys).agg(F.count_distinct(per).alias("_n")).filter(F.col("_n") == len(models))
    return fc.join(full.select(*keys), keys, "left_semi")


def blend(fc: DataFrame, a: str, b: str, weight: float, name: str) -> DataFrame:
    """weight · a + (1 − weight) · b on matched keys."""
    w = F.lit(share(weight))
    return pair_models(fc, a, b).filter("sides = 'both'").select(
        *FORECAST_KEYS, F.lit(name).alias("model"), F.col("actual_a").alias("actual"),
        (w * F.col("predicted_a") + (1 - w) * F.col("predicted_b")).alias("predicted"))


def candidate_cross(pairs: DataFrame, weights: list[float]) -> DataFrame:
    """Every pair × blend weight; an explode of a literal array, so nothing is joined."""
    return pairs.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights]))).withColumn(
        "blended", F.col("weight") * F.col("predicted_a") + (1 - F.col("weight")) * F.col("predicted_b"))


def weight_errors(pairs: DataFrame, weights: list[float], until: int) -> DataFrame:
    early = pairs.filter((F.col("horizon") == 1) & (F.col("target") <= until))
    crossed = candidate_cross(early, weights)
    return crossed.groupBy("weight").agg(F.avg(F.abs(F.col("actual") - F.col("blended"))).alias("mae"), F.count("*").alias("pairs"))


def first_minimum(df: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """Row with the smallest score per key; ties go to the first in ``order``.

    Scores are compared after rounding, so equal candidates tie however their sums were ordered.
    """
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    return df.withColumn("_k", F.row_number().over(by.orderBy(F.round(score, 6), *order))).filter("_k = 1").drop("_k")


def select_weight(pairs: DataFrame, weights: list[float], until: int) -> DataFrame:
    return first_minimum(weight_errors(pairs, weights, until), [], "mae", ["weight"])


def grid_errors(candidates: DataFrame, other: DataFrame, weights: list[float]) -> DataFrame:
    """Date-level MAE of every (candidate, weight): candidates (id, …, candidate, predicted) × one other model."""
    joined = candidates.join(other.select(*FORECAST_KEYS, F.col("predicted").alias("predicted_b")), FORECAST_KEYS)
    crossed = candidate_cross(joined.withColumnRenamed("predicted", "predicted_a"), weights)
    return crossed.groupBy("horizon", "target", "candidate", "weight").agg(
        F.avg(F.abs(F.col("actual") - F.col("blended"))).alias("mae"), F.count("*").alias("pairs"))


def select_candidate_grid(date_errors: DataFrame, until: int, order: Column) -> DataFrame:
    """First minimum of the date-balanced one-step error over the early window."""
    balanced = date_errors.filter((F.col("horizon") == 1) & (F.col("target") <= until)).groupBy("candidate", "weight").agg(
        F.avg("mae").alias("mae"), F.count("*").alias("dates")).withColumn("_o", order)
    return first_minimum(balanced, [], "mae", ["_o", "weight"]).drop("_o")


def select_sequential(date_errors: DataFrame, origins: DataFrame, window: int | None = None) -> DataFrame:
    """Per origin the candidate with the least past one-step error, over all or the last ``window`` months.

    Both sides are date-level tables, so the range join stays on the month axis.
    """
    past = date_errors.filter("horizon = 1")
    condition = F.col("target") <= F.col("origin")
    if window is not None:
        condition = condition & (F.col("target") > F.col("origin") - window)
    o = origins.select("origin").distinct()
    known = o.join(past, condition).groupBy("origin", "candidate", "weight").agg(
        F.avg("mae").alias("past_mae"), F.min("target").alias("first_target"), F.max("target").alias("last_target"))
    return first_minimum(known, ["origin"], "past_mae", ["candidate", "weight"])


def select_forecaster(fc: DataFrame, base: str, until: int, horizons: list[int]) -> DataFrame:
    """Mean over horizons of the date-balanced MAE ratio to ``base``; ties alphabetic, one model for all."""
    known = fc.filter((F.col("target") <= until) & F.col("horizon").isin(*horizons))
    by_date = known.groupBy("horizon", "model", "target").agg(F.avg(scalars.abs_error()).alias("mae"))
    mae = by_date.groupBy("horizon", "model").agg(F.avg("mae").alias("mae"))
    reference = mae.filter(F.col("model") == base).select("horizon", F.col("mae").alias("base_mae"))
    ranked = mae.join(reference, "horizon").groupBy("model").agg(F.avg(F.col("mae") / F.col("base_mae")).alias("score"))
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.round("score", 9), "model")))


#: Steps of a natural logarithm by which ratios are first counted.
RATIO_STEPS = 256


def _reached_medians(rows: DataFrame, reach: DataFrame) -> DataFrame:
    """(horizon, origin, ratio): weighted median over the rows (horizon, target, ratio, w, _bucket) of the months an origin reaches.

    Weights are summed once by month and step of the logarithm, so origins share them; only the rows of the step that holds the half meet
    the origins themselves.
    """
    sums = rows.groupBy("horizon", "target", "_bucket").agg(F.sum("w").alias("_w"))
    steps = sums.join(F.broadcast(reach), ["horizon", "target"]).groupBy("horizon", "origin", "_bucket").agg(F.sum("_w").alias("_w"))
    whole = W.partitionBy("horizon", "origin")
    run = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    chosen = (
        steps.withColumns({"_cum": F.sum("_w").over(run), "_half": F.sum("_w").over(whole) / 2}).filter(F.col("_cum") >= F.col("_half"))
        .groupBy("horizon", "origin", "_half").agg(F.min("_bucket").alias("_bucket"), F.min_by(F.col("_cum") - F.col("_w"), "_bucket").alias("_base")))
    wanted = reach.join(chosen, ["horizon", "origin"])  # a row a pair of months
    inside = rows.join(F.broadcast(wanted), ["horizon", "target", "_bucket"]).groupBy("horizon", "origin", "_half", "_base", "ratio").agg(F.sum("w").alias("_w"))
    cum = F.col("_base") + F.sum("_w").over(whole.orderBy("ratio").rowsBetween(W.unboundedPreceding, W.currentRow))
    # Sums in another order may fall short of the half by a rounding; then it is the last value of the step.
    return inside.withColumn("_hit", cum >= F.col("_half")).groupBy("horizon", "origin").agg(
        F.coalesce(F.min(F.when(F.col("_hit"), F.col("ratio"))), F.max("ratio")).alias("ratio"))


def bias_factors(fc: DataFrame, scope: str, window: int | None = None, minimum_dates: int = 2, shrink: float = 3.0,
                 low: float = 0.85, high: float = 1.15) -> DataFrame:
    """Multiplicative correction per (horizon, origin[, id]) from errors whose target is not after the origin.

    The factor is the weighted median of actual / predicted with the forecast as weight. It needs two
    dates, never moves between horizons, and the per-id form shrinks to the global one by n / (n + 3).
    """
    near = lambda target: (target <= F.col("origin")) if window is None else (target <= F.col("origin")) & (target > F.col("origin") - window)
    past = fc.filter("predicted > 0").select("horizon", "target", (F.col("actual") / F.col("predicted")).alias("ratio"), F.col("predicted").alias("w"))
    past = cut_lineage(past.withColumn("_bucket", F.floor(F.log("ratio") * RATIO_STEPS)), "ratios")
    origins = cut_lineage(fc.select("horizon", "origin").distinct(), "origins")
    # Pairs of months first; both sides have a row a month.
    reach = past.select("horizon", "target").distinct().join(F.broadcast(origins), "horizon").filter(near(F.col("target")))
    reach = cut_lineage(reach, "reach")
    dates = reach.groupBy("horizon", "origin").agg(F.count("*").alias("dates"))
    usable = reach.join(F.broadcast(dates.filter(F.col("dates") >= minimum_dates)), ["horizon", "origin"]).drop("dates")
    overall = _reached_medians(past, usable).withColumn("global_factor", scalars.clip("ratio", low, high)).drop("ratio")
    base = origins.join(dates, ["horizon", "origin"], "left").join(overall, ["horizon", "origin"], "left").select(
        "horizon", "origin", F.coalesce("dates", F.lit(0)).alias("dates"), F.coalesce("global_factor", F.lit(1.0)).alias("global_factor"))
    if scope == "global":
        return base.withColumn("factor", F.col("global_factor"))
    # One id: at most one ratio a date, so its array is bounded by the month axis and every origin reads it.
    own = F.when(F.col("predicted") > 0, F.struct((F.col("actual") / F.col("predicted")).alias("ratio"), "target", F.col("predicted").alias("w")))
    ids = fc.groupBy("horizon", "id").agg(F.sort_array(F.collect_list(own)).alias("_all"), F.collect_set("origin").alias("_origins"))
    ids = ids.select("horizon", "id", "_all", F.explode("_origins").alias("origin")).withColumn("_near", F.filter("_all", lambda x: near(x["target"])))
    ids = ids.select("horizon", "id", "origin", "_near", (F.aggregate("_near", F.lit(0.0), lambda t, x: t + x["w"]) / 2).alias("_half"))
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("at"))
    step = lambda t, x: F.struct((t["cum"] + x["w"]).alias("cum"), F.coalesce(t["at"], F.when(t["cum"] + x["w"] >= F.col("_half"), x["ratio"])).alias("at"))
    n = F.size("_near")
    local = F.when(n >= minimum_dates, F.aggregate("_near", start, step)["at"])
    ids = ids.select("horizon", "id", "origin", n.alias("_n"), local.alias("local")).join(F.broadcast(base), ["horizon", "origin"])
    trust = F.col("_n") / (F.col("_n") + shrink)
    mixed = scalars.clip(trust * F.col("local") + (1 - trust) * F.col("global_factor"), low, high)
    return ids.select(
        "horizon", "origin", "id", "dates", "global_factor",
        F.when(F.col("dates") >= minimum_dates, F.coalesce(mixed, F.col("global_factor"))).otherwise(F.lit(1.0)).alias("factor"))


def issue_release(fc: DataFrame, seasonal: str, trend: str, decision: int, lag: int, weight: float = 0.75) -> DataFrame:
    """Operational rule: last fact at decision − lag, the same blend for every horizon."""
    return blend(fc.filter(F.col("origin") == decision - lag), seasonal, trend, weight, "release").withColumn("decision", F.lit(decision))


def compare_releases(new: DataFrame, frozen: DataFrame) -> DataFrame:
    """% change of a new issue against a frozen one on one-to-one keys; range per horizon."""
    from tidepanel.operators.joins import join_checked

    joined = join_checked(
        new.select(*FORECAST_KEYS, F.col("predicted").alias("new")), frozen.select(*FORECAST_KEYS, F.col("predicted").alias("old")),
        FORECAST_KEYS, "1:1")
    return joined.filter("old > 0").select("id", "horizon", "origin", (100 * (F.col("new") / F.col("old") - 1)).alias("change_pct"))
