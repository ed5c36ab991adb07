"""Sequential detectors, thresholds and alarms.

Scores of one id are one pass over its ordered array, so the work is a single shuffle by id. A missing
month ends the run: state returns to zero and the score is NULL.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepanel.functions import scalars
from tidepanel.operators.quantiles import grouped_quantile
from tidepanel.schema import DetectorSettings
from tidepanel.session import literal_table

METHODS = ("spike", "rolling_3m", "ewma", "cusum")
EFFECT_FLOOR = math.log(1.05)


def signal_series(signal: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """keys, start, xs: dense array of the signal from the first to the last row of each unit."""
    grouped = signal.groupBy(*keys).agg(
        F.min("m").alias("start"), F.max("m").alias("stop"),
        F.map_from_entries(F.collect_list(F.struct("m", F.col(value).alias("x")))).alias("_map"))
    return grouped.select(*keys, "start", F.transform(F.sequence("start", "stop"), lambda m: F.element_at("_map", m)).alias("xs"))


def runs(signal: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """Observed rows with ``run_start`` (first month of the unbroken run) and position in the run."""
    seen = signal.filter(F.col(value).isNotNull())
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("m"))
    island = seen.withColumn("_island", F.col("m") - rank)
    by = W.partitionBy(*keys, "_island")
    return island.withColumn("run_start", F.min("m").over(by)).withColumn("position", F.col("m") - F.col("run_start") + 1).drop("_island")


STATE = ("e", "p", "n", "k", "a", "b", "c")


def quiet_state() -> Column:
    """State of the scores before a run: EWMA, both CUSUM sides, length of the run, last three values."""
    return F.struct(*[F.lit(0 if f == "k" else 0.0).alias(f) for f in STATE])


def advance(state: Column, x: Column, settings: DetectorSettings) -> Column:
    """State after one more value; a missing one ends the run."""
    alpha, drift = settings.ewma_alpha, settings.cusum_drift
    after = {"e": alpha * x + (1 - alpha) * state["e"], "p": F.greatest(F.lit(0.0), state["p"] + x - drift), "n": F.greatest(F.lit(0.0), state["n"] - x - drift),
             "k": state["k"] + 1, "a": x, "b": state["a"], "c": state["b"]}
    return F.struct(*[F.when(x.isNotNull(), after[f]).otherwise(F.lit(0 if f == "k" else 0.0)).alias(f) for f in STATE])


def read_scores(state: Column) -> Column:
    """Scores of a state, NULL outside a run."""
    seen = state["k"] > 0
    three = F.abs((state["a"] + state["b"] + state["c"]) / F.least(state["k"], F.lit(3)))
    return F.struct(F.when(seen, F.abs(state["e"])).alias("ewma"), F.when(seen, F.greatest(state["p"], state["n"])).alias("cusum"), F.when(seen, three).alias("rolling_3m"))


def state_after(xs, settings: DetectorSettings, start: Column | None = None) -> Column:
    return F.aggregate(xs, quiet_state() if start is None else start, lambda acc, x: advance(acc, x, settings))


def fold_scores(xs, settings: DetectorSettings, start: Column | None = None) -> Column:
    """Scores of every value of an array, continuing from ``start``."""
    zero = F.struct((quiet_state() if start is None else start).alias("state"), F.array().cast("array<struct<ewma:double,cusum:double,rolling_3m:double>>").alias("out"))

    def step(acc, x):
        state = advance(acc["state"], x, settings)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(read_scores(state))).alias("out"))

    return F.aggregate(xs, zero, step, lambda acc: acc["out"])


def scores(signal: DataFrame, keys: list[str], settings: DetectorSettings = DetectorSettings(), value: str = "z") -> DataFrame:
    """keys, m, z and one column per method, NULL where the month is unobserved."""
    s = signal_series(signal, keys, value)
    scored = s.select(*keys, "start", F.arrays_zip("xs", fold_scores("xs", settings).alias("o")).alias("_rows"))
    rows = scored.select(*keys, "start", F.posexplode("_rows").alias("_i", "_r"))
    return rows.select(*keys, (F.col("start") + F.col("_i")).alias("m"), F.col("_r.xs").alias("z"), F.abs("_r.xs").alias("spike"),
                       F.col("_r.o.rolling_3m").alias("rolling_3m"), F.col("_r.o.ewma").alias("ewma"), F.col("_r.o.cusum").alias("cusum"))


def by_method(wide: DataFrame, keys: list[str], methods=METHODS) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods])
    return wide.select(*keys, "m", F.col("z").isNotNull().alias("observed"), F.explode(entries).alias("_e")).select(*keys, "m", "observed", "_e.method", "_e.score")


# -- thresholds ---------------------------------------------------------------------------------
def unit_maximum(rows: DataFrame, keys: list[str], cal: tuple[int, int]) -> DataFrame:
    return rows.filter(F.col("m").between(*cal)).groupBy(*keys, "method").agg(F.max("score").alias("maximum")).filter("maximum is not null")


def threshold_unit_max(rows: DataFrame, keys: list[str], cal: tuple[int, int], q: float, group: list[str] | None = None) -> DataFrame:
    """q-quantile over units of the calibration maximum, per method."""
    group = [*(group or []), "method"]
    return grouped_quantile(unit_maximum(rows, keys, cal), group, "maximum", {"threshold": q}).withColumnRenamed("n", "units")


def threshold_per_unit(rows: DataFrame, keys: list[str], cal: tuple[int, int], floor: float = EFFECT_FLOOR) -> DataFrame:
    return unit_maximum(rows, keys, cal).select(*keys, "method", F.greatest("maximum", F.lit(floor)).alias("threshold"))


def threshold_pooled(rows: DataFrame, cal: tuple[int, int], q: float) -> DataFrame:
    inside = rows.filter(F.col("m").between(*cal) & F.col("score").isNotNull())
    return grouped_quantile(inside, ["method"], "score", {"threshold": q}).withColumnRenamed("n", "scores")


def cusum_spike(wide: DataFrame, thresholds: dict[str, float] | DataFrame, keys: list[str]) -> DataFrame:
    """Larger of CUSUM and spike, each in units of its own threshold; alarm above 1."""
    t = thresholds.groupBy().agg(*[F.max(F.when(F.col("method") == m, F.col("threshold"))).alias(f"_{m}") for m in ("cusum", "spike")])
    out = wide.crossJoin(F.broadcast(t))
    ratio = F.greatest(F.col("cusum") / F.col("_cusum"), F.col("spike") / F.col("_spike"))
    return out.select(*keys, "m", F.col("z").isNotNull().alias("observed"), F.lit("cusum_spike").alias("method"), F.when(F.col("z").isNotNull(), ratio).alias("score"))


# -- alarms -------------------------------------------------------------------------------------
def alarms(rows: DataFrame) -> DataFrame:
    """``rows`` carry score and threshold; an unobserved score never alarms."""
    return rows.withColumn("active", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)))


def alarm_episodes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First active month after an inactive or unavailable one; the previous month is found by value."""
    w = W.partitionBy(*keys).orderBy("m")
    before = F.coalesce(F.lag("active").over(w) & (F.lag("m").over(w) == F.col("m") - 1), F.lit(False))
    return rows.withColumn("episode", F.col("active") & ~before)


def monitoring_burden(rows: DataFrame, group: list[str], unit: str = "id") -> DataFrame:
    n = F.count(F.when(F.col("observed"), 1))
    out = rows.groupBy(*group).agg(
        F.count_distinct(unit).alias("units"), n.alias("observed_months"), F.count(F.when(~F.col("observed"), 1)).alias("unavailable_months"),
        F.count(F.when(F.col("active"), 1)).alias("active_months"), F.count(F.when(F.col("episode"), 1)).alias("episodes"),
        F.count_distinct(F.when(F.col("active"), F.col(unit))).alias("units_with_alarm"))
    per = lambda c: F.when(F.col("observed_months") > 0, 100 * F.col(c) / F.col("observed_months"))
    return out.withColumn("active_per100", per("active_months")).withColumn("episodes_per100", per("episodes"))


def candidate_alerts(rows: DataFrame, signal: DataFrame, growth: DataFrame, first_half: tuple[int, int], second_half: tuple[int, int]) -> DataFrame:
    """Flagged ids: first alarm month, largest score, half-period medians of signal and growth."""
    inside = rows.filter(F.col("m").between(*second_half))
    flagged = inside.groupBy("id", "threshold").agg(
        F.min(F.when(F.col("active"), F.col("m"))).alias("first_alarm"), F.max("score").alias("max_score")).filter("first_alarm is not null")
    from tidepanel.operators.quantiles import bounded_median

    z = signal.filter(F.col("m").between(*second_half)).groupBy("id").agg(bounded_median("z").alias("median_signal"))
    pct = 100 * F.expm1("growth")
    g = growth.groupBy("id").agg(bounded_median(F.when(F.col("m").between(*first_half), pct)).alias("median_yoy_before"),
                                 bounded_median(F.when(F.col("m").between(*second_half), pct)).alias("median_yoy_after"))
    return flagged.join(z, "id").join(g, "id")


def confirm_shift(levels: DataFrame, keys: list[str], thresholds: DataFrame, first: int, needed: int = 3) -> DataFrame:
    """(keys, m, event, direction): trigger, confirm, reject and, at the end, pending.

    A one-step jump above the threshold opens a candidate against the level before it. It is confirmed
    after ``needed`` consecutive months beyond the threshold in the same direction, rejected at the
    first month that is not, and a new candidate can start only in a later month.
    ``levels`` holds every month from first − 1 on; units with a gap must be left out by the caller.
    """
    s = signal_series(levels.filter(F.col("m") >= first - 1), keys, "x").join(thresholds, keys)
    event = "struct<i:int,event:string,direction:double>"
    zero = F.struct(
        F.lit(0).alias("i"), F.lit(None).cast("double").alias("prev"), F.lit(False).alias("on"), F.lit(0).alias("count"),
        F.lit(0.0).alias("anchor"), F.lit(0.0).alias("dir"), F.array().cast(f"array<{event}>").alias("out"))

    def step(acc, x):
        jump = x - acc["prev"]
        start = ~acc["on"] & F.coalesce(F.abs(jump) > F.col("threshold"), F.lit(False))
        anchor = F.when(start, acc["prev"]).otherwise(acc["anchor"])
        direction = F.when(start, F.signum(jump)).otherwise(acc["dir"])
        active = acc["on"] | start
        valid = active & ((x - anchor) * direction > F.col("threshold"))
        count = F.when(start, F.lit(0)).otherwise(acc["count"]) + valid.cast("int")
        failed, done = active & ~valid, valid & (count >= needed)
        emit = lambda flag, name, d: F.when(flag, F.array(F.struct(acc["i"].alias("i"), F.lit(name).alias("event"), d.alias("direction")))).otherwise(F.array().cast(f"array<{event}>"))
        return F.struct(
            (acc["i"] + 1).alias("i"), x.alias("prev"), (active & ~failed & ~done).alias("on"), F.when(failed | done, F.lit(0)).otherwise(count).alias("count"),
            anchor.alias("anchor"), direction.alias("dir"),
            F.concat(acc["out"], emit(start, "trigger", direction), emit(done, "confirm", direction), emit(failed, "reject", direction)).alias("out"))

    pending = lambda acc: F.concat(acc["out"], F.when(acc["on"], F.array(F.struct((acc["i"] - 1).alias("i"), F.lit("pending").alias("event"), acc["dir"].alias("direction")))).otherwise(F.array().cast(f"array<{event}>")))
    out = s.select(*keys, "start", F.explode(F.aggregate("xs", zero, step, pending)).alias("e"))
    return out.select(*keys, (F.col("start") + F.col("e.i")).alias("m"), "e.event", "e.direction")


# -- per-series recursions without a closed form -------------------------------------------------
def _stack(pdf: pd.DataFrame, column: str):
    """Arrays of a batch padded with NaN to one matrix; a padded month acts as a gap."""
    width = max((len(v) for v in pdf[column]), default=0)
    x = np.full((len(pdf), width), np.nan)
    for i, v in enumerate(pdf[column]):
        x[i, : len(v)] = np.array([np.nan if a is None else a for a in v], dtype=float)
    return x


class RunPosterior:
    """Log weights of the current run's length for a batch of series, and what each length has seen.

    Column j stands for a run of j + 1 values under a Normal–inverse-Gamma prior; only mean and scale differ between series. A
    series without a current run has no weight anywhere. ``observe`` adds one value to each series, so a batch recursion and
    a stream share it; the arrays grow by one column a step and are never cut.
    """

    def __init__(self, sigma: np.ndarray, settings: DetectorSettings, logp=None, mean=None, scale=None):
        self.settings, self.prior_scale = settings, np.asarray(sigma, float)[:, None] ** 2
        none = np.zeros((len(self.prior_scale), 0))
        self.logp, self.mean, self.scale = (none if v is None else np.atleast_2d(np.asarray(v, float)) for v in (logp, mean, scale))

    def _predictive(self, x, mean, scale, seen):
        """Log density of x after ``seen`` values: Student t with the scale of the posterior."""
        kappa, alpha = self.settings.bocpd_kappa + seen, self.settings.bocpd_alpha + seen / 2
        unit = np.array([math.lgamma(a + 0.5) - math.lgamma(a) - 0.5 * math.log(2 * a * math.pi) for a in alpha])
        variance = scale * (1 + 1 / kappa) / alpha
        return unit - 0.5 * np.log(variance) - (alpha + 0.5) * np.log1p((x - mean) ** 2 / (2 * alpha * variance))

    def _learn(self, x, mean, scale, seen):
        share = 1 / (self.settings.bocpd_kappa + seen + 1)
        return mean + (x - mean) * share, scale + 0.5 * (1 - share) * (x - mean) ** 2

    def observe(self, x: np.ndarray) -> np.ndarray:
        """P(a run begins with x | all of its series so far); NaN for a missing x, which ends the run, and for the value after."""
        x = np.asarray(x, float)[:, None]
        gap, idle = np.isnan(x), ~np.isfinite(self.logp).any(axis=1, keepdims=True)
        value, zero, lengths = np.where(gap, 0.0, x), np.zeros(1), np.arange(1, self.logp.shape[1] + 1)
        prior_mean = np.full_like(x, self.settings.bocpd_mu)
        begins = np.where(idle, 0.0, math.log(self.settings.bocpd_hazard)) + self._predictive(value, prior_mean, self.prior_scale, zero)
        goes_on = self.logp + math.log1p(-self.settings.bocpd_hazard) + self._predictive(value, self.mean, self.scale, lengths)
        joint = np.concatenate([begins, goes_on], axis=1)
        joint -= np.logaddexp.reduce(joint, axis=1, keepdims=True)
        fresh, older = self._learn(value, prior_mean, self.prior_scale, zero), self._learn(value, self.mean, self.scale, lengths)
        self.mean, self.scale = (np.concatenate(pair, axis=1) for pair in zip(fresh, older))
        self.logp = np.where(gap, -np.inf, joint)
        return np.where(gap | idle, np.nan, np.exp(joint[:, :1]))[:, 0]


def bocpd_matrix(x: np.ndarray, sigma: np.ndarray, settings: DetectorSettings) -> np.ndarray:
    """P(boundary just before x_t | x_1…x_t) for every row of ``x``; NaN after a gap and at the start."""
    runs = RunPosterior(sigma, settings)
    return np.column_stack([runs.observe(column) for column in x.T]) if x.shape[1] else np.zeros(x.shape)


def score_bocpd(signal: DataFrame, keys: list[str], sigma: DataFrame, settings: DetectorSettings = DetectorSettings()) -> DataFrame:
    """keys, m, z, score. ``sigma`` is the one-row prior scale; ids are spread by Spark, batches by Arrow."""
    s = signal_series(signal, keys).crossJoin(F.broadcast(sigma))
    fields = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", start int, xs array<double>, ps array<double>"

    def run(batches):
        for pdf in batches:
            x = _stack(pdf, "xs")
            p = bocpd_matrix(x, pdf["sigma"].to_numpy(float), settings)
            out = pdf[[*keys, "start", "xs"]].copy()
            out["ps"] = [[None if not np.isfinite(b) else float(b) for b in row[: len(v)]] for row, v in zip(p, pdf["xs"])]
            yield out

    rows = s.mapInPandas(run, schema).select(*keys, "start", F.posexplode(F.arrays_zip("xs", "ps")).alias("_i", "_r"))
    return rows.select(*keys, (F.col("start") + F.col("_i")).alias("m"), F.col("_r.xs").alias("z"), F.col("_r.ps").alias("score"))


def segment_cost(x: np.ndarray, cost: str = "l2", gamma: float = 1.0):
    """Cost of x[i:j] for an array of starts i; splitting a segment never raises the sum, which is what pruning rests on."""
    if cost == "l2":
        c1, c2 = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
        return lambda i, j: c2[j] - c2[i] - (c1[j] - c1[i]) ** 2 / (j - i)
    if cost == "rbf":
        grid = np.zeros((len(x) + 1, len(x) + 1))
        grid[1:, 1:] = np.exp(-gamma * (x[:, None] - x[None, :]) ** 2).cumsum(0).cumsum(1)
        return lambda i, j: (j - i) - (grid[j, j] - grid[i, j] - grid[j, i] + grid[i, i]) / (j - i)
    raise ValueError("cost must be l2 or rbf")


def best_segments(segment, n: int, penalty: float, min_size: int = 2) -> tuple[list[int], float]:
    """(interior boundaries, Σ cost) of the segmentation with the least Σ cost + penalty · boundaries, exactly, the earliest of equals.

    A start i is dropped once some j offers no more than what i would still pay to reach it: for ends that leave j a whole segment, what
    goes through j is then at least as good. Ends nearer to j may still need i, so it is kept for ``min_size`` steps.
    """
    if n < 2 * min_size:
        return [], float(segment(np.zeros(1, int), n)[0]) if n else 0.0
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    slack = 1e-9 * max(1.0, float(segment(np.zeros(1, int), n)[0]))
    starts, until = np.zeros(1, int), np.full(n + 1, n + 1)
    for j in range(min_size, n + 1):
        if j - min_size >= min_size:
            starts = np.append(starts, j - min_size)
        starts = starts[until[starts] > j]
        reach = best[starts] + segment(starts, j)
        k = int(np.argmin(reach))
        best[j], back[j] = reach[k] + penalty, starts[k]
        late = starts[reach > best[j] + slack]
        until[late] = np.minimum(until[late], j + min_size)
    out, j = [], n
    while back[j] > 0:
        j = int(back[j])
        out.append(j)
    return out[::-1], float(best[n] - penalty * len(out))


def segment_boundaries(x: np.ndarray, penalty: float, cost: str = "l2", min_size: int = 2, gamma: float = 1.0) -> list[int]:
    return best_segments(segment_cost(x, cost, gamma), len(x), penalty, min_size)[0]


def segment_path(x: np.ndarray, low: float, high: float, cost: str = "l2", min_size: int = 2, gamma: float = 1.0) -> list[tuple[float, float, list[int], float]]:
    """(from, to, boundaries, Σ cost): every segmentation that is optimal for some penalty in [low, high], by ascending penalty.

    Two optima with costs a > b and m < n boundaries are equal at (a - b) / (n - m). If the search there finds nothing better, none lies
    between them; otherwise both sides are searched. So the number of searches is about twice that of the answers.
    """
    segment = segment_cost(x, cost, gamma)
    ask = lambda penalty: best_segments(segment, len(x), penalty, min_size)
    found = {len(b): (b, c) for b, c in (ask(low), ask(high))}
    open_pairs = [(max(found), min(found))]
    while open_pairs:
        many, few = open_pairs.pop()
        if many - few > 1:
            level = (found[few][1] - found[many][1]) / (many - few)
            b, c = ask(level)
            if few < len(b) < many and c + level * len(b) < found[few][1] + level * few - 1e-9 * max(1.0, abs(found[few][1])):
                found[len(b)] = b, c
                open_pairs += [(many, len(b)), (len(b), few)]
    counts = sorted(found, reverse=True)
    turns = [low, *[(found[m][1] - found[n][1]) / (n - m) for n, m in zip(counts, counts[1:])], high]
    return [(float(a), float(z), *found[n]) for n, a, z in zip(counts, turns, turns[1:])]


def _costs(x: np.ndarray, cost: str, gamma: float):
    """``segment_cost`` of many series of one length: cost of x[row, i:j] by rows and all starts i before ``stop``."""
    zero = np.zeros((len(x), 1))
    if cost == "l2":
        c1, c2 = np.hstack([zero, np.cumsum(x, axis=1)]), np.hstack([zero, np.cumsum(x * x, axis=1)])

        def of(rows):
            a, b = c1[rows], c2[rows]
            return lambda stop, j: b[:, j, None] - b[:, :stop] - (a[:, j, None] - a[:, :stop]) ** 2 / (j - np.arange(stop))

        return of
    if cost == "rbf":
        grid = np.zeros((len(x), x.shape[1] + 1, x.shape[1] + 1))
        grid[:, 1:, 1:] = np.exp(-gamma * (x[:, :, None] - x[:, None, :]) ** 2).cumsum(1).cumsum(2)

        def of(rows):
            g = grid[rows]
            own = np.diagonal(g, axis1=1, axis2=2)
            return lambda stop, j: (j - np.arange(stop)) - (own[:, j, None] - g[:, :stop, j] - g[:, j, :stop] + own[:, :stop]) / (j - np.arange(stop))

        return of
    raise ValueError("cost must be l2 or rbf")


def _best_of_each(segment, n: int, penalty: np.ndarray, min_size: int) -> list[tuple[list[int], float]]:
    """``best_segments`` of many series of length ``n``, each with its penalty; all ends advance together, so nothing is pruned."""
    if n < 2 * min_size:
        return [([], float(c)) for c in (segment(1, n)[:, 0] if n else np.zeros(len(penalty)))]
    best, back, own = np.full((len(penalty), n + 1), np.inf), np.zeros((len(penalty), n + 1), int), np.arange(len(penalty))
    best[:, 0] = -penalty
    for j in range(min_size, n + 1):
        stop = max(1, j - min_size + 1)
        reach = best[:, :stop] + segment(stop, j)  # a start too near to 0 has no segmentation before it and stays infinite
        k = np.argmin(reach, axis=1)
        best[:, j], back[:, j] = reach[own, k] + penalty, k
    out = []
    for row, total, p in zip(back.tolist(), best[:, n], penalty):
        j, cuts = n, []
        while row[j] > 0:
            j = row[j]
            cuts.append(j)
        out.append((cuts[::-1], float(total - p * len(cuts))))
    return out


def segment_paths(x: np.ndarray, low: float, high: float, cost: str = "l2", min_size: int = 2, gamma: float = 1.0) -> list[list[tuple[float, float, list[int], float]]]:
    """``segment_path`` of many series of one length: a round of searches serves all of them."""
    of, n = _costs(x, cost, gamma), x.shape[1]
    ask = lambda rows, penalty: _best_of_each(of(rows), n, np.asarray(penalty, float), min_size)
    every = np.arange(len(x))
    found = [{len(b): (b, c) for b, c in pair} for pair in zip(ask(every, np.full(len(x), low)), ask(every, np.full(len(x), high)))]
    pairs = [(i, max(f), min(f)) for i, f in enumerate(found)]
    while pairs := [p for p in pairs if p[1] - p[2] > 1]:
        levels = [(found[i][few][1] - found[i][many][1]) / (many - few) for i, many, few in pairs]
        later = []
        for (i, many, few), level, (b, c) in zip(pairs, levels, ask(np.array([p[0] for p in pairs]), levels)):
            least = found[i][few][1]
            if few < len(b) < many and c + level * len(b) < least + level * few - 1e-9 * max(1.0, abs(least)):
                found[i][len(b)] = b, c
                later += [(i, many, len(b)), (i, len(b), few)]
        pairs = later
    out = []
    for f in found:
        counts = sorted(f, reverse=True)
        turns = [low, *[(f[m][1] - f[n][1]) / (n - m) for n, m in zip(counts, counts[1:])], high]
        out.append([(float(a), float(z), *f[n]) for n, a, z in zip(counts, turns, turns[1:])])
    return out


def segmentations(signal: DataFrame, keys: list[str], low: float, high: float, sigma: DataFrame, cost: str = "l2", min_size: int = 2) -> DataFrame:
    """(keys, penalty_from, penalty_to, boundaries, cost, months): every optimal segmentation of a series for penalties in [low, high].

    ``months`` are the first months of the new segments. Missing months are skipped.
    """
    s = signal_series(signal, keys).crossJoin(F.broadcast(sigma))
    fields = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    shape = ", ".join(f"{k} {fields[k]}" for k in keys) + ", penalty_from double, penalty_to double, boundaries int, cost double, months array<int>"
    names = [part.split(" ")[0] for part in shape.split(", ")]

    def run(batches):
        for pdf in batches:
            found, alike = [], {}
            for unit, start, xs, scale in zip(pdf[keys].itertuples(index=False, name=None), pdf["start"], pdf["xs"], pdf["sigma"]):
                x = np.array([np.nan if a is None else a for a in xs], dtype=float)
                seen = np.flatnonzero(np.isfinite(x))
                alike.setdefault(len(seen), []).append((unit, start + seen, x[seen] / scale))
            for n, group in alike.items():
                few = max(1, min(1000, 4_000_000 // (n + 1) ** 2)) if cost == "rbf" else 1000
                for first in range(0, len(group), few):
                    part = group[first:first + few]
                    for (unit, at, _), path in zip(part, segment_paths(np.array([g[2] for g in part]), low, high, cost, min_size)):
                        found += [[*unit, a, z, len(b), total, [int(at[i]) for i in b]] for a, z, b, total in path]
            yield pd.DataFrame(found, columns=names)

    # series are small beside the search, so their number of tasks must not follow their bytes
    spark = s.sparkSession
    return s.repartition(2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInPandas(run, shape)


def offline_changepoints(signal: DataFrame, keys: list[str], penalties: list[float], sigma: DataFrame, cost: str = "l2", min_size: int = 2) -> DataFrame:
    """(keys, penalty, m): first month of every new segment, per penalty; one search serves all penalties of a series."""
    paths = segmentations(signal, keys, min(penalties), max(penalties), sigma, cost, min_size)
    return _at_penalties(paths, keys, penalties).select(*keys, "penalty", F.explode("months").alias("m"))


def _at_penalties(paths: DataFrame, keys: list[str], penalties: list[float]) -> DataFrame:
    top = float(max(penalties))
    asked = F.array(*[F.lit(float(p)) for p in sorted(penalties)])
    own = F.filter(asked, lambda p: (p >= F.col("penalty_from")) & ((p < F.col("penalty_to")) | ((p == top) & (F.col("penalty_to") == top))))
    return paths.withColumn("penalty", F.explode(own))


def penalty_under_budget(boundaries: DataFrame, months_observed: DataFrame, penalties: list[float], budget_per100: float) -> DataFrame:
    """Smallest penalty whose boundary rate on unaltered data meets the budget; no row if none does."""
    grid = literal_table(boundaries.sparkSession, [(float(p),) for p in penalties], "penalty double")
    counts = boundaries.groupBy("penalty").agg(F.count("*").alias("alarms"))
    rated = F.broadcast(grid).join(counts, "penalty", "left").crossJoin(F.broadcast(months_observed))
    rated = rated.withColumn("per100", 100 * F.coalesce("alarms", F.lit(0)) / F.col("months"))
    return rated.withColumn("passes", F.col("per100") <= budget_per100).withColumn("chosen", F.col("passes") & (
        F.col("penalty") == F.min(F.when(F.col("passes"), F.col("penalty"))).over(W.partitionBy(F.lit(1)))))


def least_penalty(paths: DataFrame, months_observed: DataFrame, budget_per100: float, digits: int = 6) -> DataFrame:
    """(penalty, alarms, per100): the least penalty of all, not of a grid, at which the boundary rate meets the budget.

    The number of boundaries only falls where a series passes to its next segmentation, so it is a running sum over those penalties, rounded
    up to ``digits``. That sum runs over ranges of penalties first, so no task sees all series. No row if the budget is never met.
    """
    up = F.ceil(F.col("penalty_from") * 10**digits) / 10**digits
    falls = paths.groupBy(up.alias("penalty")).agg(F.sum("boundaries").alias("gained"))
    left = paths.groupBy((F.ceil(F.col("penalty_to") * 10**digits) / 10**digits).alias("penalty")).agg(F.sum("boundaries").alias("lost"))
    top = paths.agg(F.max("penalty_to").alias("_top"))
    steps = falls.join(left, "penalty", "full").select("penalty", (F.coalesce("gained", F.lit(0)) - F.coalesce("lost", F.lit(0))).alias("change"))
    steps = steps.crossJoin(F.broadcast(top)).filter(F.col("penalty") < F.col("_top")).withColumn("part", F.floor("penalty"))
    parts = steps.groupBy("part").agg(F.sum("change").alias("_c")).select(
        "part", F.coalesce(F.sum("_c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    counted = steps.join(parts, "part").withColumn("alarms", F.col("_before") + F.sum("change").over(W.partitionBy("part").orderBy("penalty")))
    rated = counted.crossJoin(F.broadcast(months_observed)).withColumn("per100", 100 * F.col("alarms") / F.col("months")).filter(F.col("per100") <= budget_per100)
    return rated.groupBy().agg(F.min(F.struct("penalty", "alarms", "per100")).alias("b")).filter("b is not null").select("b.*")


# -- event matching -----------------------------------------------------------------------------
def best_matching(truth, found, tolerance: int) -> Column:
    """One-to-one pairs of two ascending arrays within the tolerance: most pairs first, then the least total distance.

    On a line an optimal matching never crosses, so a fold over ``found`` carries the best matching with every prefix of ``truth``. Of equal
    ones the later found month is paired.
    """
    pair = "array<struct<truth:int,found:int>>"
    empty = F.struct(F.lit(0).alias("left"), F.lit(0).alias("cost"), F.array().cast(pair).alias("pairs"))
    rank = lambda s: F.struct(s["left"], s["cost"])

    def take(row, f):
        def extend(done, t):
            i = F.size(done)
            skip_truth, skip_found, before = F.get(done, i - 1), F.get(row, i), F.get(row, i - 1)
            gap = F.abs(t - f)
            paired = F.struct((before["left"] - 1).alias("left"), (before["cost"] + gap).alias("cost"),
                              F.concat(before["pairs"], F.array(F.struct(t.alias("truth"), f.alias("found")))).alias("pairs"))
            skipped = F.when(rank(skip_truth) <= rank(skip_found), skip_truth).otherwise(skip_found)
            return F.concat(done, F.array(F.when((gap <= tolerance) & (rank(paired) <= rank(skipped)), paired).otherwise(skipped)))

        return F.aggregate(truth, F.array(empty), extend)

    return F.aggregate(found, F.transform(F.sequence(F.lit(0), F.size(truth)), lambda _: empty), take, lambda row: F.element_at(row, -1)["pairs"])


def match_events(df: DataFrame, keys: list[str], tolerance: int = 1) -> DataFrame:
    """Adds matched pairs and onset counts to rows with ``truth`` and ``found`` month arrays; all in the JVM.

    Onset counts score the first true boundary only; a return boundary that is found is neutral.
    """
    months = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<int>")).cast("array<int>")))
    rows = df.select(*keys, months("truth").alias("truth"), months("found").alias("found"))
    rows = rows.withColumn("matches", best_matching("truth", "found", tolerance)).withColumn("_on", best_matching(F.slice("truth", 1, 1), "found", tolerance))
    rows = rows.withColumn("_rest", F.array_except("found", F.transform("_on", lambda p: p["found"])))
    rows = rows.withColumn("_neutral", F.size(best_matching(F.slice("truth", 2, F.size("truth")), "_rest", tolerance)))
    tp, on = F.size("matches"), F.size("_on")
    first = F.get("_on", F.lit(0))
    return rows.select(
        *keys, "matches", tp.alias("tp"), (F.size("found") - tp).alias("fp"), (F.size("truth") - tp).alias("fn"), on.alias("onset_tp"),
        (F.size("_rest") - F.col("_neutral")).alias("onset_fp"), (F.least(F.size("truth"), F.lit(1)) - on).alias("onset_fn"),
        F.when(on > 0, F.greatest(F.lit(0), first["found"] - first["truth"])).alias("onset_delay"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def event_scores(matched: DataFrame, group: list[str], months_per_series: int, null_label: str = "no_change") -> DataFrame:
    """Precision, recall, F1 and null alarms per group and shape, and pooled over shapes ("all").

    ``matched`` carries ``shape``; the null rate always has the unaltered series as denominator. With a column ``n`` a row stands for that many
    series.
    """
    n = F.col("n") if "n" in matched.columns else F.lit(1)
    null = F.col("shape") == null_label
    delay = F.aggregate("matches", F.lit(0), lambda a, m: a + (m["found"] - m["truth"]))
    size = F.aggregate("matches", F.lit(0), lambda a, m: a + F.abs(m["found"] - m["truth"]))
    counts = ("tp", "fp", "fn", "onset_tp", "onset_fp", "onset_fn")
    # the shape is a grouping column, so what is null of it is kept beside
    rows = matched.select(*group, "shape", n.cast("long").alias("series"), *[(F.col(c) * n).cast("long").alias(c) for c in counts], (delay * n).alias("_s"), (size * n).alias("_a"),
                          (F.col("onset_delay") * n).alias("_d"), F.when(F.col("onset_delay").isNotNull(), n).alias("_dn"),
                          F.when(null, F.col("fp") * n).alias("_nf"), F.when(null, n).alias("_nn"))
    sums = rows.groupingSets([[*group, "shape"], group], *group, "shape").agg(*[F.sum(c).alias(c) for c in ("series", *counts, "_s", "_a", "_d", "_dn", "_nf", "_nn")])
    out = sums.withColumn("shape", F.coalesce("shape", F.lit("all"))).withColumn("mean_onset_delay", F.col("_d") / F.col("_dn"))
    for p in ("", "onset_"):
        tp, fp, fn = F.col(f"{p}tp"), F.col(f"{p}fp"), F.col(f"{p}fn")
        out = out.withColumn(f"{p}precision", _ratio(tp, tp + fp)).withColumn(f"{p}recall", _ratio(tp, tp + fn)).withColumn(f"{p}f1", _ratio(2 * tp, 2 * tp + fp + fn))
    return out.withColumn("null_per100", _ratio(100 * F.col("_nf"), F.col("_nn") * months_per_series)).withColumn(
        "mean_signed_error", _ratio(F.col("_s"), F.col("tp"))).withColumn("mean_abs_error", _ratio(F.col("_a"), F.col("tp"))).drop("_s", "_a", "_d", "_dn", "_nf", "_nn")


def choose_detector(scored: DataFrame, split: str, score: str, budget: float, min_recall: float = 0.0) -> DataFrame:
    """Best score under the null budget on the selection split; ties alphabetic; no row if none passes."""
    ok = scored.filter((F.col("split") == split) & (F.col("shape") == "all") & (F.col("null_per100") <= budget) & (F.coalesce(F.col("recall"), F.lit(0.0)) >= min_recall))
    rank = F.row_number().over(W.partitionBy("split").orderBy(F.desc_nulls_last(score), "method"))
    return ok.withColumn("_k", rank).filter("_k = 1").select("split", "method", score, "null_per100", "recall")


def window_detection(rows: DataFrame, group: list[str], monitored: tuple[int, int], window: tuple[int, int], keys: list[str], changed: Column) -> DataFrame:
    """Active share, any alarm, and detection in a bounded window (NULL for unchanged series)."""
    inside = rows.filter(F.col("m").between(*monitored)).groupBy(*group, *keys).agg(
        F.avg(F.col("active").cast("double")).alias("_share"), F.max(F.col("active").cast("int")).alias("_any"),
        F.max(F.when(F.col("m").between(*window), F.col("active").cast("int"))).alias("_win"))
    return inside.groupBy(*group).agg(
        (100 * F.avg("_share")).alias("active_per100"), F.avg("_any").alias("any_alarm"), F.avg("_win").alias("window_alarm")).withColumn(
        "detected_in_window", F.when(changed, F.col("window_alarm")))
