"""Injected-shock back-tests. Scenario, seed and release lag are row keys; nothing loops over series."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepanel.functions import scalars
from tidepanel.operators import detectors, prep, signals
from tidepanel.operators.quantiles import grouped_median, grouped_quantile
from tidepanel.schema import DetectorSettings
from tidepanel.session import cut_lineage, literal_table

SCENARIO = ["seed", "shift", "shape", "fraction"]


def scenario_table(spark, seeds, shifts, shapes, fractions=(0.25,)) -> DataFrame:
    """One row per combination; its size is fixed by the settings, so it may be broadcast."""
    rows = [(int(s), float(x), h, float(f)) for s in seeds for x in shifts for h in shapes for f in fractions]
    return literal_table(spark, rows, "seed long, shift double, shape string, fraction double")


def inject_shock(panel: DataFrame, scenarios: DataFrame, onset: int, span: int = 6) -> DataFrame:
    """(scenario, id, m, value, treated): treated rows from the onset on are multiplied, all else is untouched."""
    crossed = panel.crossJoin(F.broadcast(scenarios)).withColumn("treated", scalars.id_uniform(F.col("seed"), "id") < F.col("fraction"))
    k = F.col("m") - onset
    factor = F.when(F.col("treated") & (k >= 0), scalars.shock_factor("shape", "shift", k, span)).otherwise(F.lit(1.0))
    return crossed.withColumn("value", F.when(factor == 1.0, F.col("value")).otherwise(F.col("value") * factor))


METHODS = (*detectors.METHODS, "cusum_spike")


def _prepare(panel: DataFrame, scenarios: DataFrame, onset: int, cal: tuple[int, int], settings: DetectorSettings, span: int, lead: int, group: list[str],
             noise: tuple[float, float] | None) -> tuple[DataFrame, list, dict, dict]:
    """One stored row an id (growth in the span, state of the scores before it, unaltered scores, draws), the scenarios, and by group the thresholds
    and the medians of every scenario, a matrix scenarios × months. Only the last three, as large as the settings, reach the driver."""
    unit, last = [*group, "id"], onset + span - 1
    arrays = cut_lineage(prep.series(panel.filter(F.col("m") <= last), unit), "series")
    growth_at = lambda m: scalars.log_ratio(prep.at(m), prep.at(m - 12))
    span_growth = F.transform(F.sequence(F.lit(onset), F.lit(last)), growth_at)

    # one row an id: unaltered scores, and what every scenario starts from
    rows = signals.signal_yoy_level(signals.yoy_of_series(arrays, group, last), cal, group, parts=True)
    if noise:
        rows = cut_lineage(rows, "signals")
        rows = rows.join(signals.noise_scale(rows, cal, *noise, group), unit).withColumn("z", F.col("z") * F.col("multiplier"))
    else:
        rows = rows.withColumn("multiplier", F.lit(1.0))
    units = rows.groupBy(*unit).agg(
        F.min("m").alias("start"), F.first("base").alias("base"), F.first("multiplier").alias("multiplier"),
        F.map_from_entries(F.collect_list(F.struct("m", F.struct("z", "growth")))).alias("_map"))
    months_of = lambda first, field: F.transform(F.sequence(first, F.lit(last)), lambda m: F.element_at("_map", m)[field])
    units = units.withColumns({"xs": months_of(F.col("start"), "z"), "growth": months_of(F.lit(onset), "growth")})
    units = units.withColumn("scored", F.zip_with("xs", detectors.fold_scores("xs", settings), lambda x, o: F.struct(
        x.isNotNull().cast("double").alias("observed"), F.abs(x).alias("spike"), *[o[m].alias(m) for m in detectors.METHODS[1:]])))
    at = lambda m: F.get("scored", (m - F.col("start")).cast("int"))
    top = lambda c: F.array_max(F.transform(F.sequence(F.lit(cal[0]), F.lit(cal[1])), lambda m: at(m)[c]))
    before = lambda c: F.transform(F.sequence(F.lit(onset - lead), F.lit(last)), lambda m: at(m)[c])
    state = detectors.state_after(F.slice("xs", 1, F.greatest(F.lit(0), onset - F.col("start"))), settings)
    seeds = sorted({r["seed"] for r in scenarios.select("seed").distinct().collect()})
    drawn = F.array(*[scalars.id_uniform(F.lit(s), "id") for s in seeds])  # once an id and seed
    units = cut_lineage(units.withColumn("_s", state).select(
        *unit, "base", "multiplier", "growth", F.array(*[F.col(f"_s.{f}").cast("double") for f in detectors.STATE]).alias("state"), drawn.alias("draws"),
        *[before(c).alias(f"before_{c}") for c in ("observed", *detectors.METHODS)], *[top(m).alias(f"top_{m}") for m in detectors.METHODS]), "units")
    tops = units.select(*group, F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"top_{m}").alias("maximum")) for m in detectors.METHODS])).alias("_t")).select(*group, "_t.*")
    named: dict[tuple, dict] = {}
    for r in grouped_quantile(tops.filter("maximum is not null"), [*group, "method"], "maximum", {"threshold": settings.threshold_quantile}).collect():
        named.setdefault(tuple(r[g] for g in group), {})[r["method"]] = r["threshold"]

    # a month's median depends on seed and share of the treated and on the size of the shock there: scenarios that agree in them share it
    plan = scenarios.withColumn("shock", F.array(*[F.log(scalars.shock_factor("shape", "shift", F.lit(k), span)) for k in range(span)])).collect()
    case = lambda r, k: (seeds.index(r["seed"]), r["fraction"], k, r["shock"][k]) if r["shock"][k] else (0, 0.0, k, 0.0)
    cases = sorted({case(r, k) for r in plan for k in range(span)})
    table = literal_table(panel.sparkSession, [(i, *c) for i, c in enumerate(cases)], "case int, _seed int, _fraction double, k int, _shock double")
    every = arrays.select(*unit, span_growth.alias("growth"), drawn.alias("_u")).crossJoin(F.broadcast(table))
    g = F.get("growth", F.col("k"))
    every = every.select(*group, "case", F.when(F.get("_u", F.col("_seed")) < F.col("_fraction"), g + F.col("_shock")).otherwise(g).alias("x")).filter("x is not null")
    medians: dict[tuple, dict] = {}
    for r in grouped_median(every, [*group, "case"], "x").collect():
        medians.setdefault(tuple(r[g] for g in group), {})[cases[r["case"]]] = r["median"]
    common = {key: np.array([[m.get(case(r, k), np.nan) for k in range(span)] for r in plan]) for key, m in medians.items()}
    plan = [{**r.asDict(), "_seed": seeds.index(r["seed"])} for r in plan]
    return units, plan, {key: {m: t.get(m, np.nan) for m in detectors.METHODS} for key, t in named.items()}, common


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of equally long lists; nulls become NaN."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _over(row: dict[str, np.ndarray], limits: dict[str, float]) -> np.ndarray:
    """Which scores pass their thresholds, methods first; unknown ones don't."""
    joint = np.fmax(row["cusum"] / limits["cusum"], row["spike"] / limits["spike"])
    return np.array([*[row[m] > limits[m] for m in detectors.METHODS], joint > 1])


def _step(x: np.ndarray, state, s: DetectorSettings) -> tuple[tuple, np.ndarray, dict[str, np.ndarray]]:
    """State after one more month, what is observed of it, and its scores."""
    e, p, n, k, a, b, _ = state
    seen = ~np.isnan(x)
    keep = lambda v: np.where(seen, v, 0.0)
    e, p, n = keep(s.ewma_alpha * x + (1 - s.ewma_alpha) * e), keep(np.maximum(0.0, p + x - s.cusum_drift)), keep(np.maximum(0.0, n - x - s.cusum_drift))
    k, a, b, c = keep(k + 1), keep(x), keep(a), keep(b)
    return (e, p, n, k, a, b, c), seen, {"spike": np.abs(x), "ewma": np.abs(e), "cusum": np.maximum(p, n), "rolling_3m": np.abs((a + b + c) / np.clip(k, 1, 3))}


def _changed(z: np.ndarray, state: np.ndarray, limits: dict[str, float], s: DetectorSettings) -> np.ndarray:
    """Alarms of altered signals (ids × scenarios × months) that go on from the ids' states: bits by month, methods first."""
    state = tuple(np.broadcast_to(v[:, None], z.shape[:2]) for v in state.T)
    bits = np.zeros((len(METHODS), *z.shape[:2]), np.int64)
    for t in range(z.shape[2]):
        state, seen, score = _step(z[:, :, t], state, s)
        bits |= (_over(score, limits) & seen).astype(np.int64) << t
    return bits


def _flags(panel: DataFrame, scenarios: DataFrame, onset: int, cal: tuple[int, int], settings: DetectorSettings = DetectorSettings(), span: int = 6, lead: int = 0,
           group: list[str] | None = None, noise: tuple[float, float] | None = None, counted: bool = False) -> DataFrame:
    """(scenario, group, id, treated, method, observed, base, changed): flags as bits, the first month of a path lowest. ``counted`` gives the
    number of ids, ``n``, with the same flags instead of the ids: each task counts its batches first."""
    group = group or []
    length = span + lead
    if length > 20:
        raise ValueError("paths of at most twenty months")
    units, plan, limits, common = _prepare(panel, scenarios, onset, cal, settings, span, lead, group, noise)
    kinds = {f.name: f.dataType.simpleString() for f in units.schema.fields}
    one = "n long" if counted else f"id {kinds['id']}"
    shape = ", ".join(["seed long, shift double, shape string, fraction double", *[f"{g} {kinds[g]}" for g in group], one, "treated boolean, method string, observed long, base long, changed long"])
    shock = np.array([r["shock"] for r in plan])
    seed, fraction = np.array([r["_seed"] for r in plan]), np.array([r["fraction"] for r in plan])
    columns = {c: pa.array([r[c] for r in plan]) for c in SCENARIO}
    methods, full = pa.array(METHODS), (1 << length) - 1
    weights = 1 << np.arange(length)

    def part(batch, key, keep):
        """Scenario, method, row, and flags of the ids of one group."""
        now = common[key][keep]
        growth, draws, state = _matrix(batch, "growth"), _matrix(batch, "draws"), _matrix(batch, "state")
        base, multiplier = (batch.column(c).to_numpy(zero_copy_only=False).astype(float)[:, None, None] for c in ("base", "multiplier"))
        treated = draws[:, seed[keep]] < fraction[keep]
        altered = np.where(treated[:, :, None], growth[:, None, :] + shock[keep][None], growth[:, None, :])
        changed = _changed((altered - now[None] - base) * multiplier, state, limits[key], settings)
        known = {c: _matrix(batch, f"before_{c}") for c in ("observed", *detectors.METHODS)}
        observed, quiet = ((known["observed"] > 0) * weights).sum(axis=1), (_over(known, limits[key]) * weights).sum(axis=2)
        changed = (changed << lead) | (quiet & ((1 << lead) - 1))[:, :, None]
        return treated, observed, quiet, changed

    def run(batches):
        for whole in batches:
            names = list(zip(*[whole.column(g).to_pylist() for g in group])) if group else [()] * whole.num_rows
            where: dict[tuple, list[int]] = {}
            for i, key in enumerate(names):
                where.setdefault(key, []).append(i)
            for key, own in where.items():
                if key not in limits or key not in common:
                    continue
                keep = np.flatnonzero(~np.isnan(common[key]).all(axis=1))
                for first in range(0, len(own), 1000):
                    batch = whole.take(pa.array(own[first:first + 1000]))
                    with np.errstate(invalid="ignore", divide="ignore"):
                        treated, observed, quiet, changed = part(batch, key, keep)
                    n, s, m = len(observed), len(keep), len(METHODS)
                    if counted:
                        packed = ((((quiet[:, :, None] << length) | changed) << length | observed[None, :, None]) << 1) | treated[None]
                        found = [np.unique(packed[i, :, j], return_counts=True) for j in range(s) for i in range(m)]
                        sizes = [len(f[0]) for f in found]
                        values, of_row = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                        scenario, method = np.repeat(np.repeat(keep, m), sizes), np.repeat(np.tile(np.arange(m), s), sizes)
                        hit, values = (values & 1).astype(bool), values >> 1
                        ones = pa.array(of_row)
                        flags = [values & full, values >> 2 * length, (values >> length) & full]
                    else:
                        scenario, method = np.tile(np.repeat(keep, m), n), np.tile(np.arange(m), n * s)
                        ones = batch.column("id").take(pa.array(np.repeat(np.arange(n), s * m)))
                        hit = np.repeat(treated.ravel(), m)
                        flags = [np.repeat(observed, s * m), np.repeat(quiet.T, s, axis=0).ravel(), changed.transpose(1, 2, 0).ravel()]
                    at = pa.array(scenario)
                    of_group = [batch.column(g).take(pa.array(np.zeros(len(at), np.int64))) for g in group]
                    yield pa.record_batch([*[columns[c].take(at) for c in SCENARIO], *of_group, ones, pa.array(hit), methods.take(pa.array(method)), *[pa.array(f) for f in flags]],
                                          [*SCENARIO, *group, "n" if counted else "id", "treated", "method", "observed", "base", "changed"])

    out = units.drop(*[f"top_{m}" for m in detectors.METHODS]).mapInArrow(run, shape)
    if counted:
        out = out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))
    return out


def _month(i: Column, lead: int) -> dict[str, Column]:
    """The flags of one month of a path."""
    bit = lambda c: F.call_function("bit_get", F.col(c), i) == 1
    return {"k": i - lead, "observed": bit("observed"), "base_alarm": bit("base"), "changed_alarm": bit("changed"), "new_alarm": bit("changed") & ~bit("base")}


def _with_path(flags: DataFrame, span: int, lead: int) -> DataFrame:
    month = lambda i: F.struct(*[c.alias(n) for n, c in _month(i, lead).items()])
    path = F.transform(F.sequence(F.lit(0), F.lit(span + lead - 1)), month)
    return flags.withColumn("path", path).drop("observed", "base", "changed")


def unit_paths(panel: DataFrame, scenarios: DataFrame, onset: int, cal: tuple[int, int], settings: DetectorSettings = DetectorSettings(), span: int = 6, lead: int = 0,
               group: list[str] | None = None, noise: tuple[float, float] | None = None) -> DataFrame:
    """(scenario, group, id, treated, method, path): flags of the span after onset, and of ``lead`` months before, in one array a unit.

    A shock adds the logarithm of its factor to the log growth of treated ids. All else that a scenario changes is the panel median of each
    month, so scenarios are a small table of paths and medians beside one stored row an id: its growth in the span, its state of
    the scores before it, and its unaltered flags. Thresholds come from the unaltered calibration months, per ``group`` (categories, cohorts);
    ``noise`` (weight, floor) scales signals by ``signals.noise_scale``.
    """
    return _with_path(_flags(panel, scenarios, onset, cal, settings, span, lead, group, noise), span, lead)


def path_counts(panel: DataFrame, scenarios: DataFrame, onset: int, cal: tuple[int, int], settings: DetectorSettings = DetectorSettings(), span: int = 6, lead: int = 0,
                group: list[str] | None = None, noise: tuple[float, float] | None = None) -> DataFrame:
    """(scenario, group, treated, method, n, path): how many ids have each path of ``unit_paths``. The metrics read it alike; its size follows the
    different paths, not the ids."""
    return _with_path(_flags(panel, scenarios, onset, cal, settings, span, lead, group, noise, True), span, lead)


def run(panel: DataFrame, scenarios: DataFrame, onset: int, cal: tuple[int, int], settings: DetectorSettings = DetectorSettings(), span: int = 6, lead: int = 0, **kw) -> DataFrame:
    """``unit_paths`` with a row for each month: k, observed, base_alarm, changed_alarm, new_alarm."""
    flags = _flags(panel, scenarios, onset, cal, settings, span, lead, **kw)
    rows = flags.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(span + lead - 1))))
    return rows.select(*[c for c in flags.columns if c not in ("observed", "base", "changed")], *[c.alias(n) for n, c in _month(F.col("_i"), lead).items()])


def _first_k(shape: Column) -> Column:
    """A ramp has no effect in its first month."""
    return F.when(shape == "ramp", 1).otherwise(0)


def _units(results: DataFrame) -> list[str]:
    """Columns that name a scenario and method; categories or cohorts among them."""
    return [c for c in results.columns if c not in ("id", "n", "treated", "path", "k", "observed", "base_alarm", "changed_alarm", "new_alarm")]


def per_unit(results: DataFrame) -> DataFrame:
    """One row per (scenario, method, id) with bounded arrays of flags by month after onset, from ``unit_paths`` or rows of ``run``; ``n`` ids a row
    from ``path_counts``."""
    if "path" not in results.columns:
        results = results.groupBy(*_units(results), "id", "treated").agg(
            F.sort_array(F.collect_list(F.struct("k", "observed", "base_alarm", "changed_alarm", "new_alarm"))).alias("path"))
    return (results if "n" in results.columns else results.withColumn("n", F.lit(1))).withColumn("onset", _first_k(F.col("shape")))


def _count(condition: Column) -> Column:
    """Ids of the rows that meet a condition."""
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def _mean(value: Column, condition: Column) -> Column:
    """Mean over those ids; NULL without any."""
    return F.sum(F.when(condition, value.cast("double") * F.col("n"))) / F.sum(F.when(condition & value.isNotNull(), F.col("n")))


def _any(flag: str, condition) -> Column:
    return F.exists("path", lambda p: p[flag] & condition(p))


def _first(flag: str) -> Column:
    hits = F.filter("path", lambda p: p[flag] & (p["k"] >= F.col("onset")))
    return F.when(F.size(hits) > 0, F.get(hits, F.lit(0))["k"] - F.col("onset"))


def attribution_metrics(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """New alarms at onset and by the 2nd and 3rd month among all treated, delay, and control rates."""
    group = group or _units(results)
    u = per_unit(results)
    by = lambda n: _any("new_alarm", lambda p: (p["k"] >= F.col("onset")) & (p["k"] < F.col("onset") + n))
    ever = _any("new_alarm", lambda p: p["k"] >= F.col("onset"))
    u = u.select(*group, "n", "treated", by(1).alias("at1"), by(2).alias("at2"), by(3).alias("at3"), ever.alias("ever"), _first("new_alarm").alias("delay"),
                 _any("base_alarm", lambda p: F.lit(True)).alias("base"), _any("changed_alarm", lambda p: F.lit(True)).alias("changed"), _any("new_alarm", lambda p: F.lit(True)).alias("new"))
    rate = lambda c, side: _mean(c, F.col("treated") == side)
    # Delays are small integers within the span, so an exact percentile buffers a handful of values.
    return u.groupBy(*group).agg(
        rate(F.col("at1"), True).alias("new_at_onset"), rate(F.col("at2"), True).alias("new_by_second"), rate(F.col("at3"), True).alias("new_by_third"),
        rate(F.col("ever"), True).alias("new_any"), rate(~F.col("at1") & F.col("ever"), True).alias("later_only"),
        F.percentile(F.when(F.col("treated"), F.col("delay")), 0.5, F.col("n")).alias("median_delay"),
        rate(F.col("base"), True).alias("base_treated"), rate(F.col("changed"), True).alias("changed_treated"),
        rate(F.col("base"), False).alias("base_control"), rate(F.col("changed"), False).alias("changed_control"), rate(F.col("new"), False).alias("new_control"))


def observed_window_metrics(results: DataFrame) -> DataFrame:
    """The same with ids whose whole window is observed as denominators, and control burdens per 100."""
    u = per_unit(results)
    full = lambda n: ~F.exists("path", lambda p: (p["k"] >= F.col("onset")) & (p["k"] < F.col("onset") + n) & ~p["observed"])
    by = lambda n: _any("new_alarm", lambda p: (p["k"] >= F.col("onset")) & (p["k"] < F.col("onset") + n))
    count = lambda f: F.size(F.filter("path", lambda p: f(p) & (p["k"] >= F.col("onset"))))
    aggs = []
    for n, label in ((1, "first"), (2, "second"), (3, "third")):
        ok = F.col("treated") & full(n)
        aggs += [_count(ok).alias(f"observed_{label}"), _mean(by(n), ok).alias(f"new_by_{label}")]
    control = lambda c: F.sum(F.when(~F.col("treated"), c * F.col("n")))
    out = u.groupBy(*_units(results)).agg(
        _count(F.col("treated")).alias("treated_n"), _count(~F.col("treated")).alias("control_n"), *aggs,
        F.sum(F.when(F.col("treated"), count(lambda p: ~p["observed"]) * F.col("n"))).alias("unobserved_treated_months"),
        control(count(lambda p: p["new_alarm"])).alias("_n"), control(count(lambda p: p["base_alarm"])).alias("_b"), control(count(lambda p: p["observed"])).alias("_o"))
    per = lambda c: F.when(F.col("_o") > 0, 100 * F.col(c) / F.col("_o"))
    return out.withColumn("new_control_per100", per("_n")).withColumn("base_control_per100", per("_b")).drop("_n", "_b", "_o")


def calendar_delay_metrics(results: DataFrame, lags: list[int], span: int = 6) -> DataFrame:
    """Detection by calendar month once alarms arrive ``lag`` months after their source month."""
    u = per_unit(results).withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags])))
    arrival = lambda p: p["k"] + F.col("lag")
    source = lambda p: (p["k"] >= F.col("onset")) & p["observed"]
    full3 = ~F.exists("path", lambda p: (p["k"] >= F.col("onset")) & (p["k"] < F.col("onset") + 3) & ~p["observed"])
    by = lambda n: F.exists("path", lambda p: source(p) & p["new_alarm"] & (arrival(p) <= F.col("onset") + n - 1))
    delivered = lambda p: source(p) & (arrival(p) <= span - 1)
    hits = F.filter("path", lambda p: delivered(p) & p["new_alarm"])
    first = F.when(F.size(hits) > 0, F.get(hits, F.lit(0))["k"] + F.col("lag") - F.col("onset"))
    ok = F.col("treated") & full3
    size = lambda f: F.size(F.filter("path", f))
    u = u.withColumn("_ok", ok).withColumn("_first", F.when(ok, first))
    months = lambda side, f: F.sum(F.when(F.col("treated") == side, size(f) * F.col("n")))
    out = u.groupBy(*_units(results), "lag").agg(
        _count(F.col("treated")).alias("treated_n"), _count(F.col("_ok")).alias("evaluated_n"),
        *[_mean(by(n), F.col("_ok")).alias(f"new_by_{label}") for n, label in ((1, "first"), (2, "second"), (3, "third"))],
        _mean(F.col("_first").isNotNull(), F.col("_ok")).alias("new_by_end"), F.percentile("_first", 0.5, F.col("n")).alias("median_delay"),
        months(True, lambda p: source(p) & (arrival(p) > span - 1)).alias("pending_months"), months(False, delivered).alias("_d"),
        months(False, lambda p: delivered(p) & p["new_alarm"]).alias("_n"), months(False, lambda p: delivered(p) & p["base_alarm"]).alias("_b"))
    per = lambda c: F.when(F.col("_d") > 0, 100 * F.col(c) / F.col("_d"))
    return out.withColumn("delivered_control_months", F.col("_d")).withColumn("new_control_per100", per("_n")).withColumn("base_control_per100", per("_b")).drop("_d", "_n", "_b")


def alarm_rates(results: DataFrame, prevalence: float = 0.25) -> DataFrame:
    """Treated and control alarm rates, suppressed and previously quiet shares (scope and shape studies).

    ``precision`` is the share of true alarms if ``prevalence`` of the ids changed, whatever share was drawn.
    """
    any_ = lambda c, before=None: F.exists("path", lambda p: p[c] & (p["k"] < before) if before is not None else p[c]).cast("int")
    hits_of = F.filter("path", lambda p: p["changed_alarm"])
    u = per_unit(results).select(*_units(results), "n", "treated", any_("base_alarm").alias("b"), any_("changed_alarm").alias("c"), F.get(hits_of, F.lit(0))["k"].alias("first"),
                                 any_("changed_alarm", 1).alias("c1"), any_("changed_alarm", 3).alias("c3"))
    t, quiet = F.col("treated"), F.col("b") == 0
    rate = lambda c, side: _mean(c, t == side)
    out = u.groupBy(*_units(results)).agg(
        _count(t).alias("treated_n"), _count(~t).alias("control_n"), rate(F.col("c"), True).alias("treated_rate"), rate(F.col("b"), True).alias("treated_base_rate"),
        rate((F.col("c") == 1) & quiet, True).alias("new_rate"), _mean(F.col("c"), t & quiet).alias("new_rate_quiet"),
        rate((F.col("b") == 1) & (F.col("c") == 0), True).alias("suppressed_rate"), rate(F.col("c"), False).alias("control_rate"), rate(F.col("b"), False).alias("control_base_rate"),
        rate(F.col("c1"), True).alias("by_first"), rate(F.col("c3"), True).alias("by_third"), F.percentile(F.when(t, F.col("first")), 0.5, F.col("n")).alias("median_delay"))
    hits, false = prevalence * F.col("treated_rate"), (1 - prevalence) * F.col("control_rate")
    return out.withColumn("precision", F.when(hits + false > 0, hits / (hits + false)))


def pareto_frontier(table: DataFrame, scenario: list[str], burden: str, detection: str) -> DataFrame:
    """Methods no other method beats in burden and detection within the scenario.

    The table has one row per scenario and method, so the self join is bounded by the method count.
    """
    a, b = table.alias("a"), table.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in scenario]
    better = (F.col(f"b.{burden}") <= F.col(f"a.{burden}")) & (F.col(f"b.{detection}") >= F.col(f"a.{detection}")) & (
        (F.col(f"b.{burden}") < F.col(f"a.{burden}")) | (F.col(f"b.{detection}") > F.col(f"a.{detection}")))
    condition = better
    for s in same:
        condition = condition & s
    return a.join(b, condition, "left_anti").select("a.*")


def scenario_envelope(table: DataFrame, keys: list[str], burden: str, detection: str) -> DataFrame:
    return table.groupBy(*keys).agg(F.min(detection).alias("detection_min"), F.max(detection).alias("detection_max"), F.max(burden).alias("burden_max"), F.count("*").alias("scenarios"))


def capacity_choice(envelope: DataFrame, keys: list[str], caps: list[float]) -> DataFrame:
    """Best worst-case detection under each burden cap; all tied methods are listed."""
    rows = envelope.withColumn("cap", F.explode(F.array(*[F.lit(float(c)) for c in caps]))).filter(F.col("burden_max") <= F.col("cap"))
    best = rows.groupBy(*keys, "cap").agg(F.max("detection_min").alias("best"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("eligible"))
    tied = rows.join(best, [*keys, "cap"]).filter("detection_min = best")
    return tied.groupBy(*keys, "cap", "eligible", "best").agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))


def choose_under_capacity(runs: DataFrame, selection_seeds: list[int], cap: float, minimum: float, detection: str, burden: str) -> DataFrame:
    """Detector chosen on the selection seeds, reported on the others."""
    side = F.when(F.col("seed").isin(*selection_seeds), "selection").otherwise("evaluation")
    means = runs.withColumn("side", side).groupBy("side", "method").agg(F.avg(detection).alias("detection"), F.avg(burden).alias("burden"))
    ok = means.filter((F.col("side") == "selection") & (F.col("burden") <= cap) & (F.col("detection") >= minimum))
    pick = ok.withColumn("_k", F.row_number().over(W.partitionBy("side").orderBy(F.desc("detection"), "burden", "method"))).filter("_k = 1").select("method")
    return means.join(pick, "method", "left_semi")


def induced_error_path(base: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Median change of the log error per month after a common shock; both tables are (keys, id, k, error)."""
    both = changed.withColumnRenamed("error", "_c").join(base.withColumnRenamed("error", "_b"), ["id", "k"]).withColumn("diff", F.col("_c") - F.col("_b"))
    return grouped_median(both, [*keys, "k"], "diff", "induced").drop("n")


def level_scores(panel: DataFrame, regions: DataFrame, cal: tuple[int, int], minimum: int, last: int, keys: list[str] | None = None,
                 settings: DetectorSettings = DetectorSettings()) -> DataFrame:
    """(keys, level, unit, m, method, observed, score) of the panel, its large regions and the ids around their region, each around its
    calibration median."""
    keys = keys or []
    unit = [*keys, "level", "unit"]
    levels = signals.signal_levels(signals.yoy_log(panel, keys, last), regions, minimum, keys)
    base = levels.filter(F.col("m").between(*cal)).groupBy(*unit).agg(F.percentile("z", 0.5).alias("_c"))  # the months of one unit
    centred = levels.join(base, unit).withColumn("z", F.col("z") - F.col("_c"))
    return detectors.by_method(detectors.scores(centred.select(*unit, "m", "z"), unit, settings), unit)


def background_rates(rows: DataFrame, group: list[str], unit: str) -> DataFrame:
    """(group, units, alarm_rate, mean_alarm_months, first_alarm) of unaltered data; ``rows`` carry active."""
    own = rows.groupBy(*group, unit).agg(F.count(F.when(F.col("active"), 1)).alias("_a"), F.min(F.when(F.col("active"), F.col("m"))).alias("_f"))
    return own.groupBy(*group).agg(F.count("*").alias("units"), F.avg((F.col("_a") > 0).cast("double")).alias("alarm_rate"), F.avg("_a").alias("mean_alarm_months"), F.min("_f").alias("first_alarm"))


def _right(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A column of lists that end together as one matrix; NaN before their start and for nulls."""
    column = batch.column(name)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((batch.num_rows, width), np.nan)
    out[np.arange(width)[None, :] >= width - sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return out


def level_stress(panel: DataFrame, regions: DataFrame, onset: int, cal: tuple[int, int], minimum: int, shifts: list[float], shapes: list[str],
                 seeds: list[int], settings: DetectorSettings = DetectorSettings(), span: int = 6) -> DataFrame:
    """Shocks to the whole panel, to each of the three largest regions and, for every seed, to a quarter of the ids.

    Every level is judged at its own units only: (scope, scenario, shift, shape, level, method) rates. Scenarios differ in the span alone, by the
    logarithm of the shock: its months get a median for each set of hit ids and each size of the shock, and one stored row an id meets
    all scenarios as arrays. Tasks count units of equal outcome, so nothing is repeated for the scenarios.
    """
    if cal[1] >= onset or span > 12:
        raise ValueError("calibration before the onset and a span of at most a year")
    spark, last = panel.sparkSession, onset + span - 1
    draws = F.array(*[scalars.id_uniform(F.lit(str(s)), "id") < 0.25 for s in seeds])
    growth = F.transform(F.sequence(F.col("start") + 12, F.lit(last)), lambda m: scalars.log_ratio(prep.at(m), prep.at(m - 12)))
    growth = F.when(F.col("start") + 12 <= last, growth).otherwise(F.array().cast("array<double>"))
    units = prep.series(panel.filter(F.col("m") <= last)).join(regions.select("id", "region"), "id", "left")
    units = cut_lineage(units.select("region", growth.alias("growth"), draws.alias("draws")), "units")
    sizes = units.filter("region is not null").groupBy("region").agg(F.count("*").alias("n"), F.count(F.when(F.size("growth") > 0, 1)).alias("grown"))
    largest = [r["name"] for r in sizes.filter(F.col("n") >= minimum).orderBy(F.desc("n"), "region").limit(3).select(F.col("region").cast("string").alias("name")).collect()]
    eligible = sizes.filter(F.col("grown") >= minimum).select("region")
    units = units.filter(F.size("growth") > 0)
    width = max(span, units.agg(F.max(F.size("growth"))).first()[0] or 0)  # months of the axis, the last one the end of the span

    scopes = [("national", "all"), *[("local", str(s)) for s in seeds], *[("regional", r) for r in largest]]
    of_region = lambda other: F.array(F.lit(True), *other, *[F.coalesce(F.col("region").cast("string") == r, F.lit(False)) for r in largest])
    units = units.withColumn("hit", of_region([F.get("draws", F.lit(i)) for i in range(len(seeds))])).drop("draws")
    grid = literal_table(spark, [(float(s), h) for s in shifts for h in shapes], "shift double, shape string")
    grid = grid.withColumn("shock", F.array(*[F.log(scalars.shock_factor("shape", "shift", F.lit(k), span)) for k in range(span)])).collect()
    plan = [(i, *scopes[i], r["shift"], r["shape"], [np.nan if x is None else x for x in r["shock"]]) for i in range(len(scopes)) for r in grid]

    # medians of the axis, then of the months of the span by set of hit ids and size of the shock: scenarios that agree in them share one
    def medians(rows, keys, chosen):
        cases = sorted({(p[0], k, p[5][k]) for p in plan if scopes[p[0]][0] in chosen for k in range(span) if p[5][k] and p[5][k] == p[5][k]})
        place = {c: width + i for i, c in enumerate(cases)}
        x = rows.select(*keys, "hit", "growth", F.posexplode("growth").alias("_i", "x")).select(*keys, (F.lit(width) - F.size("growth") + F.col("_i")).alias("case"), "x")
        if cases:
            table = literal_table(spark, [(place[c], *c) for c in cases], "case int, _hit int, _k int, _shock double")
            ends = rows.select(*keys, "hit", F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda k: F.get("growth", F.size("growth") - span + k)).alias("_ends"))
            g = F.get("_ends", F.col("_k"))
            x = x.unionByName(ends.crossJoin(F.broadcast(table)).select(*keys, "case", F.when(F.get("hit", F.col("_hit")), g + F.col("_shock")).otherwise(g).alias("x")))
        found = grouped_median(x.filter("x is not null"), [*keys, "case"], "x").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("case", "median"))).alias("_map"))
        found = found.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(width + len(cases) - 1)), lambda c: F.element_at("_map", c)).alias("medians"))
        where = np.array([[place.get((p[0], k, p[5][k]), width - span + k) for k in range(span)] for p in plan])
        return cut_lineage(found, "medians"), where

    inside = units.join(eligible, "region", "left_semi")
    regional, where = medians(inside, ["region"], ("local",))
    national, everywhere = medians(units, [], ("local", "regional"))
    none = [F.lit(False)] * len(seeds)
    regional_units = regional.select("medians", of_region(none).alias("hit"))
    national_units = national.select("medians", F.array(F.lit(True), *none, *[F.lit(False) for _ in largest]).alias("hit"))
    local_units = inside.select("region", "growth", "hit").join(regional, "region").drop("region")

    index, shock = np.array([p[0] for p in plan]), np.array([p[5] for p in plan])
    seeded = np.array([scopes[i][0] == "local" for i in index])
    first, methods = width - span, len(detectors.METHODS)
    calibration = slice(max(0, first - (onset - cal[0])), max(0, first - (onset - cal[1]) + 1))

    def outcomes(level, batch, where):
        """How many units of a batch meet each scenario, method, target or not, base alarm or not, and month of the first alarm."""
        hit = _matrix(batch, "hit")[:, index] > 0
        centre = _matrix(batch, "medians")
        z0, z = centre[:, :width], centre[:, where]
        shifted = hit & ~seeded if level == "local" else hit  # a median whose ids are all hit moves with them
        z = np.where(shifted[:, :, None], z + shock[None], z)
        known0, known = ~np.isnan(z0[:, first:]), ~np.isnan(z)
        if level == "local":
            own = _right(batch, "growth", width)
            inside = np.arange(first, width)[None, :] >= width - np.diff(batch.column("growth").offsets.to_numpy())[:, None]
            known0, known = known0 & inside, known & inside[:, None, :]
            z = np.where(hit[:, :, None], own[:, None, first:] + shock[None], own[:, None, first:]) - z
            z0 = own - z0
        c = np.full(len(z0), np.nan)
        any_ = ~np.isnan(z0[:, calibration]).all(axis=1)
        if any_.any():
            c[any_] = np.nanmedian(z0[any_, calibration], axis=1)
        z0, z = z0 - c[:, None], z - c[:, None, None]
        state, top = tuple(np.zeros((len(detectors.STATE), len(z0)))), {m: np.full(len(z0), np.nan) for m in detectors.METHODS}
        for t in range(first):
            state, seen, score = _step(z0[:, t], state, settings)
            if calibration.start <= t < calibration.stop:
                top = {m: np.fmax(v, np.where(seen, score[m], np.nan)) for m, v in top.items()}
        limits = {m: np.maximum(v, detectors.EFFECT_FLOOR)[:, None] for m, v in top.items()}
        state = np.array(state).T
        base = _changed(z0[:, None, first:], state, limits, settings)[:methods, :, 0] > 0
        bits = _changed(z, state, limits, settings)[:methods]
        delay = np.where(bits > 0, np.log2(np.maximum(bits & -bits, 1)).astype(np.int64) + 1, 0)  # months from the onset plus one, 0 without an alarm
        kept = np.array([~np.isnan(top[m]) for m in detectors.METHODS])[:, :, None] & (known0.any(axis=1)[:, None] & known.any(axis=2))[None]
        scenario, method = np.arange(len(plan))[None, None, :], np.arange(methods)[:, None, None]
        packed = (((scenario * methods + method) * 2 + hit[None]) * 2 + base[:, :, None]) * 16 + delay
        return np.bincount(packed[kept], minlength=len(plan) * methods * 64)

    shape = "scope string, scenario string, shift double, shape string, level string, method string, target boolean, base int, found int, delay int, n long"
    names = [part.split()[0] for part in shape.split(", ")]

    def judge(level, where):
        def run(batches):
            total = np.zeros(len(plan) * methods * 64, np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    with np.errstate(invalid="ignore", divide="ignore"):
                        total += outcomes(level, whole.slice(at, 1000), where)
            code = np.flatnonzero(total)
            delay, base, target, method, scenario = code % 16, code // 16 % 2, code // 32 % 2 > 0, code // 64 % methods, code // 64 // methods
            columns = [pa.array([plan[i][j] for i in scenario], pa.float64() if j == 3 else pa.string()) for j in range(1, 5)]
            yield pa.record_batch([*columns, pa.array([level] * len(code), pa.string()), pa.array([detectors.METHODS[i] for i in method], pa.string()), pa.array(target), pa.array(base, pa.int32()),
                                   pa.array((delay > 0).astype(np.int32)), pa.array(delay - 1, pa.int32(), mask=delay == 0), pa.array(total[code])], names)

        return run

    judged = local_units.mapInArrow(judge("local", where), shape).unionByName(regional_units.mapInArrow(judge("regional", where), shape)).unionByName(
        national_units.mapInArrow(judge("national", everywhere), shape))
    rate = lambda c, side: _mean(c, F.col("target") == side)
    return judged.groupBy("scope", "scenario", "shift", "shape", "level", "method").agg(
        (F.first("scope") == F.first("level")).alias("intended"), _count(F.col("target")).alias("target_units"), _count(~F.col("target")).alias("control_units"),
        rate(F.col("found"), True).alias("target_rate"), rate(F.col("base"), True).alias("target_base_rate"), rate((F.col("found") == 1) & (F.col("base") == 0), True).alias("target_new_rate"),
        rate(F.col("found"), False).alias("control_rate"), F.percentile(F.when(F.col("target"), F.col("delay")), 0.5, F.col("n")).alias("median_delay"))
