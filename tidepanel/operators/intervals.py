"""Prediction intervals from past errors only.

The calibration radius is an order statistic at ⌈(n + 1)·coverage⌉. Which past months calibrate which
target is decided on the month axis, then rows join by equality of the month.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions import scalars
from tidepanel.operators import guards
from tidepanel.operators.quantiles import order_statistics
from tidepanel.session import cut_lineage, literal_table


def finite_quantile(df: DataFrame, keys: list[str], score: str, coverage: float, name: str = "q", clamp: bool = False) -> DataFrame:
    """Order statistic ⌈(n + 1)·c⌉ per group: infinite beyond n, or the largest value with ``clamp``."""
    rank = lambda n: F.ceil((n + 1) * coverage)
    wanted = (lambda n: F.least(rank(n), n)) if clamp else rank
    out = order_statistics(df, keys, score, {name: (coverage, wanted)})
    return out.withColumn(name, F.coalesce(name, F.lit(float("inf"))))


def bounds(center, radius) -> dict[str, Column]:
    center, radius = (F.col(c) if isinstance(c, str) else c for c in (center, radius))
    return {"lower": F.greatest(center - radius, F.lit(0.0)), "upper": F.greatest(center + radius, F.lit(0.0))}


def interval_score(actual, lower, upper, alpha: float) -> Column:
    actual, lower, upper = (F.col(c) if isinstance(c, str) else c for c in (actual, lower, upper))
    miss = F.greatest(lower - actual, F.lit(0.0)) + F.greatest(actual - upper, F.lit(0.0))
    return (upper - lower) + F.lit(2.0 / alpha) * miss


def window_pairs(targets: DataFrame, policy: str, window: int = 3, fixed: tuple[int, int] | None = None, start: int | None = None) -> DataFrame:
    """(target, cal_target): months that may calibrate each target, all strictly earlier.

    ``targets`` is the distinct month axis of the forecasts, so this range join is calendar-sized.
    """
    t = cut_lineage(targets.select("target").distinct(), "months")
    c = t.withColumnRenamed("target", "cal_target")
    condition = F.col("cal_target") < F.col("target")
    if policy == "rolling":
        condition = condition & (F.col("cal_target") >= F.col("target") - window)
    elif policy == "fixed":
        condition = condition & F.col("cal_target").between(*fixed)
    elif policy != "expanding":
        raise ValueError("policy must be rolling, fixed or expanding")
    if start is not None:
        condition = condition & (F.col("cal_target") >= start)
    return t.join(F.broadcast(c), condition)  # at most one row a month of the calendar


def normaliser(strategy: str, floor: float = 1.0) -> Column:
    if strategy == "raw":
        return F.lit(1.0)
    if strategy == "scaled_mean":
        return F.greatest(F.col("mean_value"), F.lit(floor))
    if strategy == "scaled_forecast":
        return F.greatest(F.abs("predicted"), F.lit(floor))
    raise ValueError("unknown interval strategy")


def calibrated(fc: DataFrame, pairs: DataFrame, strategy: str, coverage: float, keys: list[str] | None = None,
               floor: float = 1.0, clamp: bool = False) -> DataFrame:
    """Forecast rows with lower, upper, covered, width and score for every target that has calibration months.

    ``keys`` calibrates each group on its own; a row without a group is an error of the caller.
    """
    keys = keys or []
    rows = fc.withColumn("norm", normaliser(strategy, floor)).withColumn("score", scalars.abs_error() / F.col("norm"))
    cal = rows.select(*keys, F.col("target").alias("cal_target"), "score").join(pairs, "cal_target")
    q = finite_quantile(cal, [*keys, "target"], "score", coverage, clamp=clamp).withColumnRenamed("n", "calibration_rows")
    out = rows.drop("score").join(q, [*keys, "target"])
    for name, c in bounds("predicted", F.col("q") * F.col("norm")).items():
        out = out.withColumn(name, c)
    return out.withColumn("covered", F.col("actual").between(F.col("lower"), F.col("upper"))).withColumn(
        "width", F.col("upper") - F.col("lower")).withColumn("interval_score", interval_score("actual", "lower", "upper", 1 - coverage))


def calibrate_by_group(fc: DataFrame, groups: DataFrame, group: str, pairs: DataFrame, strategy: str, coverage: float) -> DataFrame:
    rows = cut_lineage(fc.join(groups.select("id", group), "id", "left"), "grouped")  # the guard, scores and intervals read it
    guards.assert_empty(rows.filter(F.col(group).isNull()), "id without a calibration group")
    return calibrated(rows, pairs, strategy, coverage, [group])


def calibration_gaps(fc: DataFrame, pairs: DataFrame) -> DataFrame:
    """(target, cal_target) whose calibration ids differ from the target's ids, on either side.

    Equal coverage means equal counts and no calibration id outside the target's set.
    """
    ids = fc.select("id", "target")
    sizes = ids.groupBy("target").agg(F.count("*").alias("n"))
    cal = ids.withColumnRenamed("target", "cal_target").join(pairs, "cal_target")
    both = cal.join(ids, ["id", "target"]).groupBy("target", "cal_target").agg(F.count("*").alias("shared"))
    cal_n = sizes.withColumnRenamed("target", "cal_target").withColumnRenamed("n", "cal_n")
    joined = pairs.join(sizes, "target").join(cal_n, "cal_target").join(both, ["target", "cal_target"], "left")
    return joined.withColumn("shared", F.coalesce("shared", F.lit(0))).filter("shared <> n or shared <> cal_n")


def calibration_for_origin(fc: DataFrame, coverage: float = 0.8, months_needed: int = 3) -> DataFrame:
    """Per origin: scaled radius of the last three completed months; origins lacking a month are absent."""
    rows = fc.withColumn("score", scalars.abs_error() / scalars.positive_or_null("mean_value")).filter("score is not null")
    axis = rows.select("target").distinct()
    pairs = axis.withColumn("origin", F.explode(F.sequence(F.col("target"), F.col("target") + months_needed - 1)))
    full = pairs.groupBy("origin").agg(F.count("*").alias("_n")).filter(F.col("_n") == months_needed).select("origin")
    cal = rows.select("id", "target", "score").join(pairs.join(full, "origin"), "target")
    q = finite_quantile(cal, ["origin"], "score", coverage, "normalized_radius", clamp=True).withColumnRenamed("n", "observations")
    span = cal.groupBy("origin").agg(F.count_distinct("id").alias("ids"), F.min("target").alias("first_target"), F.max("target").alias("last_target"))
    return q.join(span, "origin")


def widen_for_events(intervals: DataFrame, known: DataFrame, factor: float) -> DataFrame:
    """Radius × factor where an event of the id was public by the end of the origin month; centre unchanged."""
    flags = known.select("id", "origin").distinct().withColumn("_known", F.lit(True))
    out = intervals.join(flags, ["id", "origin"], "left").withColumn("event_known", F.coalesce("_known", F.lit(False))).drop("_known")
    out = out.withColumn("radius", F.col("radius") * F.when(F.col("event_known"), F.lit(factor)).otherwise(F.lit(1.0)))
    return out.withColumn("lower", F.col("predicted") - F.col("radius")).withColumn("upper", F.col("predicted") + F.col("radius"))


def interval_summary(rows: DataFrame, group: str) -> DataFrame:
    """Date-balanced coverage, width and score, with the worst date and the worst group."""
    dates = rows.groupBy("target").agg(F.avg(F.col("covered").cast("double")).alias("c"), F.avg("width").alias("w"), F.avg("interval_score").alias("s"), F.count("*").alias("n"))
    groups = rows.groupBy(group).agg(F.avg(F.col("covered").cast("double")).alias("c")).agg(F.min("c").alias("minimum_group_coverage"))
    return dates.agg(F.avg("c").alias("coverage"), F.min("c").alias("minimum_date_coverage"), F.avg("w").alias("width"), F.avg("s").alias("interval_score"),
                     F.count("*").alias("dates"), F.sum("n").alias("rows")).crossJoin(F.broadcast(groups))


#: Steps of a natural logarithm that a score is filed under, coarse and fine: 256 and 2^20 a unit.
_COARSE, _FINE = 256, 1 << 20


class RankIndex:
    """Order statistics of a stored column over any months, without a sort of it.

    The driver holds how many scores of a month fall under each coarse step of their logarithm: months × steps numbers. What is under one
    step is counted by fine steps, and under one of these by value, only when asked for. The table is sorted by step, so such a
    question reads a few of its row groups.
    """

    def __init__(self, rows: DataFrame):
        step = lambda k: F.when(F.col("score") > 0, F.floor(F.log("score") * k)).otherwise(F.lit(-(1 << 40)))
        self.rows = cut_lineage(rows.withColumns({"_coarse": step(_COARSE), "_fine": step(_FINE)}).repartitionByRange("_coarse", "target").sortWithinPartitions("_coarse", "target"), "ranked")
        self.counts: dict[int, dict[int, int]] = {}
        for r in self.rows.groupBy("target", "_coarse").agg(F.count("*").alias("n")).collect():
            self.counts.setdefault(r["target"], {})[r["_coarse"]] = r["n"]

    def _find(self, counts: dict, rank: int):
        for key in sorted(counts):
            if rank <= counts[key]:
                return key, rank
            rank -= counts[key]

    def value(self, months: list[int], rank: int) -> float | None:
        """The rank-th smallest score of ``months``; infinite beyond them, None without any."""
        merged: dict[int, int] = {}
        for m in months:
            for key, n in self.counts.get(m, {}).items():
                merged[key] = merged.get(key, 0) + n
        if not merged:
            return None
        if rank > sum(merged.values()):
            return float("inf")
        coarse, rank = self._find(merged, rank)
        under = self.rows.filter((F.col("_coarse") == coarse) & F.col("target").isin(months))
        by = lambda df, c: {r[c]: r["count"] for r in df.groupBy(c).count().collect()}  # noqa: E731 at most 2^12 fine steps of a coarse one
        if merged[coarse] > 1 << 12:
            fine, rank = self._find(by(under, "_fine"), rank)
            under = under.filter(F.col("_fine") == fine)
        return self._find(by(under, "score"), rank)[0]

    def size(self, months: list[int]) -> int:
        return sum(sum(self.counts.get(m, {}).values()) for m in months)


def calibrate_adaptive(fc: DataFrame, targets: list[int], coverage: float, gamma: float, window: int = 3,
                       low: float = 0.005, high: float = 0.5, floor: float = 1.0) -> DataFrame:
    """Feedback calibration: after each month α ← clip(α + γ·(α₀ − miss)), used from the next month on.

    The recursion runs over the calendar and its state is one number. A month asks ``RankIndex`` for one order statistic of the months
    before it and counts its own rows outside the bounds.
    """
    nominal = 1 - coverage
    rows = fc.withColumn("norm", normaliser("scaled_mean", floor)).withColumn("score", scalars.abs_error() / F.col("norm"))
    index = RankIndex(rows.select("id", "target", "actual", "predicted", "norm", "score"))
    alpha, issued = nominal, []
    for target in targets:
        past = [target - k for k in range(1, window + 1)]
        q = index.value(past, math.ceil((index.size(past) + 1) * (1 - alpha)))
        own = index.rows.filter(F.col("target") == target)
        for name, c in bounds("predicted", F.lit(q) * F.col("norm")).items():
            own = own.withColumn(name, c)
        covered = own.agg(F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double"))).first()[0] if q is not None else None
        if covered is None:
            raise ValueError("missing calibration or evaluation month")
        issued.append((target, float(alpha), float(q)))
        alpha = min(max(alpha + gamma * (nominal - (1 - covered)), low), high)
    steps = literal_table(fc.sparkSession, issued, "target int, alpha double, q double")
    out = index.rows.drop("_coarse", "_fine").join(F.broadcast(steps), "target")
    for name, c in bounds("predicted", F.col("q") * F.col("norm")).items():
        out = out.withColumn(name, c)
    return out.withColumn("covered", F.col("actual").between(F.col("lower"), F.col("upper"))).withColumn(
        "width", F.col("upper") - F.col("lower")).withColumn("interval_score", interval_score("actual", "lower", "upper", nominal))
