"""Accuracy, paired comparison and descriptive summaries of forecast tables.

Row-level facts are read once: several grains come out of one aggregation by grouping sets.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepanel.functions import months, scalars
from tidepanel.operators import prep
from tidepanel.operators.quantiles import drop_largest, grouped_median, grouped_quantile, top_share
from tidepanel.session import cut_lineage

GROUP = ["model", "horizon"]
TOLERANCE = 1e-9


def with_errors(fc: DataFrame) -> DataFrame:
    """Absolute error, and growth-space values where the base exists (month-over-month only at h = 1)."""
    return (
        fc.withColumn("ae", scalars.abs_error())
        .withColumn("yoy_actual", scalars.pct_change("actual", "year_ago")).withColumn("yoy_predicted", scalars.pct_change("predicted", "year_ago"))
        .withColumn("mom_actual", F.when(F.col("horizon") == 1, scalars.pct_change("actual", "level")))
        .withColumn("mom_predicted", F.when(F.col("horizon") == 1, scalars.pct_change("predicted", "level"))))


def _grains(rows: DataFrame, group: list[str], extra: list[str], *aggs: Column) -> DataFrame:
    """One pass over ``rows`` for the grains group + each of ``extra`` and group alone; ``grain`` names it."""
    sets = [[*group, e] for e in extra] + [group]
    out = rows.groupingSets(sets, *group, *extra).agg(*aggs, F.grouping_id().alias("_g"))
    top = 2 ** len(extra) - 1
    label = F.lit("all")
    for i, e in enumerate(extra):
        label = F.when(F.col("_g") == top - 2 ** (len(extra) - 1 - i), e).otherwise(label)
    return out.withColumn("grain", label).drop("_g")


def one_minus_ratio(sse: Column, sst: Column) -> Column:
    return F.when(sst > 0, 1 - sse / sst)


def score_basic(fc: DataFrame) -> DataFrame:
    sse = F.sum(F.pow(F.col("actual") - F.col("predicted"), 2))
    return fc.groupBy(*GROUP).agg(
        F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count_distinct("origin").alias("origins"),
        F.avg(scalars.abs_error()).alias("mae"), sse.alias("_sse"), (F.var_pop("actual") * F.count("*")).alias("_sst"),
    ).withColumn("r2", one_minus_ratio(F.col("_sse"), F.col("_sst"))).drop("_sse", "_sst")


def summary(fc: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Date-balanced MAE, pooled and within-id R², growth-space accuracy, counts."""
    group = group or GROUP
    rows = with_errors(fc)
    sq = lambda a, b: F.sum(F.pow(F.col(a) - F.col(b), 2))
    grains = _grains(
        rows, group, ["target", "id"],
        F.count("*").alias("n"), F.avg("ae").alias("mae"), F.avg(F.abs(F.col("yoy_actual") - F.col("yoy_predicted"))).alias("yoy_mae"),
        sq("actual", "predicted").alias("sse"), (F.var_pop("actual") * F.count("actual")).alias("sst"),
        sq("yoy_actual", "yoy_predicted").alias("yoy_sse"), (F.var_pop("yoy_actual") * F.count("yoy_actual")).alias("yoy_sst"),
        sq("mom_actual", "mom_predicted").alias("mom_sse"), (F.var_pop("mom_actual") * F.count("mom_actual")).alias("mom_sst"))
    at = lambda grain, c: F.when(F.col("grain") == grain, F.col(c))
    out = grains.groupBy(*group).agg(
        F.count(at("target", "n")).alias("dates"), F.count(at("id", "n")).alias("ids"), F.max(at("all", "n")).alias("rows"),
        F.avg(at("target", "mae")).alias("mae"), F.max(at("all", "mae")).alias("mae_pooled"), F.avg(at("target", "yoy_mae")).alias("yoy_mae_pp"),
        *[F.max(at("all", c)).alias(f"_{c}") for c in ("sse", "sst", "yoy_sse", "yoy_sst", "mom_sse", "mom_sst")],
        F.sum(at("id", "sst")).alias("_within"))
    return out.select(
        *group, "dates", "ids", "rows", "mae", "mae_pooled",
        one_minus_ratio(F.col("_sse"), F.col("_sst")).alias("r2_pooled"), one_minus_ratio(F.col("_sse"), F.col("_within")).alias("r2_within"),
        "yoy_mae_pp", one_minus_ratio(F.col("_yoy_sse"), F.col("_yoy_sst")).alias("yoy_r2"),
        one_minus_ratio(F.col("_mom_sse"), F.col("_mom_sst")).alias("mom_r2"))


def skill(stats: DataFrame, reference: str) -> DataFrame:
    """1 − MAE / MAE of the reference at the same horizon."""
    ref = stats.filter(F.col("model") == reference).select("horizon", F.col("mae").alias("_ref"))
    return stats.join(ref, "horizon").withColumn("skill", 1 - F.col("mae") / F.col("_ref")).drop("_ref")


def error_shares(fc: DataFrame, scale: DataFrame) -> DataFrame:
    """WAPE, normalised MAE, bias and scaled error; ``scale`` is (id, mean_value, mean_change)."""
    rows = fc.withColumn("ae", scalars.abs_error()).withColumn("signed", scalars.signed_error()).join(scale, "id")
    grains = _grains(
        rows, GROUP, ["target"], F.sum("ae").alias("s"), F.sum("actual").alias("a"), F.avg("signed").alias("bias"),
        F.avg(F.col("ae") / scalars.positive_or_null("mean_value")).alias("nmae"), F.avg(F.col("ae") / scalars.positive_or_null("mean_change")).alias("mase"))
    at = lambda grain, c: F.when(F.col("grain") == grain, F.col(c))
    return grains.groupBy(*GROUP).agg(
        (100 * F.max(at("all", "s")) / F.max(at("all", "a"))).alias("wape_pct"), (100 * F.avg(at("target", "nmae"))).alias("nmae_pct"),
        F.avg(at("target", "bias")).alias("bias"), F.max(at("all", "mase")).alias("mase"))


def unit_errors(fc: DataFrame) -> DataFrame:
    return fc.groupBy(*GROUP, "id").agg(F.avg(scalars.abs_error()).alias("unit_mae"), F.avg(scalars.signed_error()).alias("unit_bias"), F.count("*").alias("dates"))


def error_quantiles(fc: DataFrame) -> DataFrame:
    fc = cut_lineage(fc.select(*GROUP, "id", "actual", "predicted"), "errors")  # two grains read it
    rows = grouped_quantile(fc.withColumn("ae", scalars.abs_error()), GROUP, "ae", {"median_ae": 0.5, "p90_ae": 0.9}).drop("n")
    units = grouped_quantile(unit_errors(fc), GROUP, "unit_mae", {"median_unit_mae": 0.5, "p90_unit_mae": 0.9}).withColumnRenamed("n", "ids")
    return rows.join(units, GROUP)


def concentration(fc: DataFrame, share: float = 0.05) -> DataFrame:
    """Share of the summed id errors held by the ⌈5 %⌉ worst ids."""
    return top_share(unit_errors(fc), GROUP, "unit_mae", share, "top_share")


def group_breakdown(fc: DataFrame, attributes: DataFrame, dims: list[str]) -> DataFrame:
    """MAE, bias and counts by each dimension of ``attributes`` and by target, in one pass."""
    rows = fc.withColumn("ae", scalars.abs_error()).withColumn("signed", scalars.signed_error()).join(attributes, "id")
    rows = rows.select(*GROUP, "id", "ae", "signed", *[F.col(d).cast("string").alias(d) for d in [*dims, "target"]])
    every = [*dims, "target"]
    out = _grains(rows, GROUP, every, F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.avg("ae").alias("mae"), F.avg("signed").alias("bias"))
    label = F.coalesce(*[F.when(F.col("grain") == d, F.col(d)) for d in every])
    return out.filter("grain <> 'all'").select(*GROUP, F.col("grain").alias("dimension"), label.alias("label"), "rows", "ids", "mae", "bias")


def paired_stats(pairs: DataFrame) -> DataFrame:
    """Differences b − a per horizon: date mean, win / tie / loss of rows, ids and dates, id quantiles."""
    rows = pairs.withColumn("diff", F.col("loss_b") - F.col("loss_a"))
    kind = lambda c: F.when(c < -TOLERANCE, "win").when(c > TOLERANCE, "loss").otherwise("tie")
    grains = _grains(rows, ["horizon"], ["target", "id"], F.avg("diff").alias("diff"), F.count("*").alias("n"),
                     F.count(F.when(kind(F.col("diff")) == "win", 1)).alias("wins"), F.count(F.when(kind(F.col("diff")) == "tie", 1)).alias("ties"))
    grains = cut_lineage(grains, "grains")
    is_ = lambda grain, k: F.count(F.when((F.col("grain") == grain) & (kind(F.col("diff")) == k), 1))
    at = lambda grain, c: F.when(F.col("grain") == grain, F.col(c))
    out = grains.groupBy("horizon").agg(
        F.avg(at("target", "diff")).alias("mae_difference"), F.max(at("all", "n")).alias("rows"),
        (F.max(at("all", "wins")) / F.max(at("all", "n"))).alias("row_win_share"), (F.max(at("all", "ties")) / F.max(at("all", "n"))).alias("row_tie_share"),
        *[is_("id", k).alias(f"ids_{k}") for k in ("win", "loss", "tie")], *[is_("target", k).alias(f"dates_{k}") for k in ("win", "loss", "tie")])
    units = grouped_quantile(grains.filter("grain = 'id'").drop("n"), ["horizon"], "diff", {"median_id_difference": 0.5, "p90_id_difference": 0.9}).drop("n")
    return out.join(units, "horizon")


def unit_gains(pairs: DataFrame) -> DataFrame:
    """(horizon, id): mean gain of b over a."""
    return pairs.groupBy("horizon", "id").agg(F.avg(F.col("loss_a") - F.col("loss_b")).alias("gain"), F.count("*").alias("rows"))


def win_rates(pairs: DataFrame) -> DataFrame:
    rows = pairs.groupBy("horizon").agg(F.avg(F.col("loss_a") - F.col("loss_b")).alias("mean_gain"),
                                        F.avg((F.col("loss_a") > F.col("loss_b")).cast("double")).alias("row_win_rate"))
    units = unit_gains(pairs).groupBy("horizon").agg(F.avg((F.col("gain") > 0).cast("double")).alias("id_win_rate"), F.count("*").alias("ids"))
    return rows.join(units, "horizon")


def leave_group_out(pairs: DataFrame, attributes: DataFrame, group: str) -> DataFrame:
    """Date-balanced mean difference without each group: totals minus the group's own sums, one pass."""
    cells = pairs.join(attributes.select("id", group), "id").groupBy("horizon", "target", group).agg(
        F.sum(F.col("loss_b") - F.col("loss_a")).alias("s"), F.count("*").alias("n"))
    cells = cut_lineage(cells, "cells")
    totals = cells.groupBy("horizon", "target").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    groups = cells.select("horizon", F.col(group).alias("excluded")).distinct()
    own = cells.withColumnRenamed(group, "excluded")
    rest = totals.join(groups, "horizon").join(own, ["horizon", "target", "excluded"], "left")
    left_n = F.col("tn") - F.coalesce("n", F.lit(0))
    rest = rest.withColumn("rn", left_n).filter("rn > 0").withColumn("mean", (F.col("ts") - F.coalesce("s", F.lit(0.0))) / F.col("rn"))
    return rest.groupBy("horizon", "excluded").agg(F.avg("mean").alias("difference"), F.count("*").alias("dates"), F.sum("rn").alias("rows"))


def leave_date_out(pairs: DataFrame) -> DataFrame:
    dates = pairs.groupBy("horizon", "target").agg(F.avg(F.col("loss_b") - F.col("loss_a")).alias("mean"))
    totals = dates.groupBy("horizon").agg(F.sum("mean").alias("t"), F.count("*").alias("n"))
    return dates.join(totals, "horizon").filter("n > 1").select(
        "horizon", F.col("target").alias("excluded"), ((F.col("t") - F.col("mean")) / (F.col("n") - 1)).alias("difference"))


def leave_top_out(pairs: DataFrame, expense: DataFrame, share: float = 0.05) -> DataFrame:
    """Date-balanced difference after dropping the ⌈5 %⌉ ids with the largest training expense."""
    kept = drop_largest(expense.select("id", "expense"), [], "expense", "id", share)
    dates = pairs.join(kept, "id", "left_semi").groupBy("horizon", "target").agg(F.avg(F.col("loss_b") - F.col("loss_a")).alias("mean"), F.count("*").alias("n"))
    return dates.groupBy("horizon").agg(F.avg("mean").alias("difference"), F.sum("n").alias("rows"))


def monthly_table(fc: DataFrame) -> DataFrame:
    return fc.groupBy(*GROUP, "target").agg(F.avg(scalars.abs_error()).alias("mae"), F.count("*").alias("rows"))


def monthly_contrasts(fc: DataFrame, reference: str) -> DataFrame:
    table = monthly_table(fc)
    ref = table.filter(F.col("model") == reference).select("horizon", "target", F.col("mae").alias("reference_mae"))
    return table.filter(F.col("model") != reference).join(ref, ["horizon", "target"]).withColumn("difference", F.col("mae") - F.col("reference_mae"))


def ablation_deltas(fc: DataFrame, reference: str) -> DataFrame:
    """Change of MAE against the reference, and dates improved, worsened or tied."""
    d = monthly_contrasts(fc, reference)
    return d.groupBy("model", "horizon").agg(
        F.avg("difference").alias("mae_change"), F.count(F.when(F.col("difference") < -TOLERANCE, 1)).alias("dates_improved"),
        F.count(F.when(F.col("difference") > TOLERANCE, 1)).alias("dates_worsened"), F.count(F.when(F.abs("difference") <= TOLERANCE, 1)).alias("dates_tied"))


def wrap_bias(fc: DataFrame) -> DataFrame:
    rows = fc.withColumn("bridges", months.year_bridges("origin", "horizon")).withColumn("log_error", scalars.log_ratio("predicted", "actual"))
    keys = ["model", "horizon", "bridges"]
    return grouped_median(rows, keys, "log_error", "median_log_error").withColumnRenamed("n", "rows")


def subset_metrics(grid: DataFrame) -> DataFrame:
    """Growth scenarios on all pairs and on year-crossing pairs, with the gain over zero growth."""
    rows = grid.withColumn("ae", scalars.abs_error()).withColumn(
        "subset", F.explode(F.when(F.col("bridges") > 0, F.array(F.lit("all"), F.lit("crossing"))).otherwise(F.array(F.lit("all")))))
    dates = rows.groupBy("subset", "horizon", "rate", "target").agg(F.avg("ae").alias("mae"), F.count("*").alias("n"))
    out = dates.groupBy("subset", "horizon", "rate").agg(F.avg("mae").alias("mae"), F.sum("n").alias("rows"), F.count("*").alias("dates"))
    zero = out.filter("rate = 0").select("subset", "horizon", F.col("mae").alias("_zero"))
    return out.join(zero, ["subset", "horizon"]).withColumn("gain", F.col("_zero") - F.col("mae")).drop("_zero")


def growth_bound(base: DataFrame, comparator: DataFrame, low: float, high: float) -> DataFrame:
    """With at most one year crossing the MAE is convex in the rate, so the interval ends bound it."""
    rows = base.withColumn("k", months.year_bridges("origin", "horizon")).filter("k <= 1")
    err = lambda g: F.abs(F.col("actual") - F.col("predicted") * F.pow(F.lit(1 + g), F.col("k")))
    dates = rows.groupBy("horizon", "target").agg(F.avg(err(low)).alias("lo"), F.avg(err(high)).alias("hi"))
    bound = dates.groupBy("horizon").agg(F.avg("lo").alias("low_mae"), F.avg("hi").alias("high_mae")).withColumn("bound", F.greatest("low_mae", "high_mae"))
    best = monthly_table(comparator).groupBy("model", "horizon").agg(F.avg("mae").alias("mae")).groupBy("horizon").agg(F.min("mae").alias("best_mae"))
    return bound.join(best, "horizon").withColumn("margin", F.col("best_mae") - F.col("bound")).withColumn("all_better", F.col("bound") < F.col("best_mae"))


def matched_categories(fc: DataFrame, old: str, new: str) -> DataFrame:
    """Two models per category on matched keys: date-balanced MAE and the reduction."""
    from tidepanel.operators.selection import pair_models

    keys = ["category", "id", "origin", "target", "horizon"]
    pairs = pair_models(fc, old, new, keys).filter("sides = 'both'")
    return _matched(pairs, F.abs(F.col("actual_a") - F.col("predicted_a")), F.abs(F.col("actual_b") - F.col("predicted_b")))


def matched_pairs(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """The same for two forecasts that are columns of one row, so no key is grouped."""
    return _matched(pairs, scalars.abs_error("actual", old), scalars.abs_error("actual", new))


def _matched(pairs: DataFrame, old, new) -> DataFrame:
    dates = pairs.groupBy("category", "horizon", "target").agg(F.avg(old).alias("a"), F.avg(new).alias("b"), F.count("*").alias("n"))
    return dates.groupBy("category", "horizon").agg(F.avg("a").alias("old_mae"), F.avg("b").alias("new_mae"), F.sum("n").alias("rows")).withColumn(
        "reduction_pct", 100 * (1 - F.col("new_mae") / F.col("old_mae")))


def survivorship(panel: DataFrame, year: int, last: int, horizons) -> DataFrame:
    """Pooled-profile MAE of the same pairs under the as-of cohort's profile and the balanced one's."""
    from tidepanel.operators import forecast, profiles

    balanced = prep.cohort_balanced(panel, 12 * year, last)
    known = profiles.profile_global(panel, year)
    full = profiles.profile_global(panel.join(balanced, "id", "left_semi"), year, name="p_balanced")
    rows = forecast.origin_rows(panel, year, horizons, prefix=False).join(balanced.withColumn("is_balanced", F.lit(True)), "id", "left")
    rows = rows.crossJoin(F.broadcast(known)).crossJoin(F.broadcast(full))
    ratio = lambda p: F.col("level") * profiles.factor(p, "target") / profiles.factor(p, "origin")
    ae = lambda p: F.abs(F.col("actual") - ratio(p))
    member = F.coalesce("is_balanced", F.lit(False))
    return rows.groupBy("horizon").agg(
        F.avg(F.when(member, ae("p_global"))).alias("balanced_ids_asof_mae"), F.avg(F.when(member, ae("p_balanced"))).alias("balanced_ids_balanced_mae"),
        F.avg(F.when(~member, ae("p_global"))).alias("partial_ids_mae"), F.count(F.when(~member, 1)).alias("partial_pairs"), F.count("*").alias("pairs"))


def sample_coverage(ids: DataFrame, sampled: DataFrame, group: str) -> DataFrame:
    marked = ids.join(sampled.select("id", F.lit(1).alias("_s")), "id", "left")
    return marked.groupBy(group).agg(F.count("*").alias("complete"), F.count("_s").alias("sampled")).withColumn("fraction", F.col("sampled") / F.col("complete"))


def growth_interpretation(panel: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Median nominal and real year-over-year growth by ``keys``; prices is (m, level)."""
    from tidepanel.operators.joins import year_ago_join

    base = panel.join(prices, "m").withColumn("real", scalars.real_value("value", "level"))
    unit = [k for k in ("id", "category") if k in panel.columns]
    rows = year_ago_join(base.select(*unit, "m", "value", "real", *[k for k in keys if k not in unit]), ["value", "real"], unit)
    rows = rows.withColumn("nominal_yoy_pct", scalars.pct_change("value", "value_year_ago")).withColumn("real_yoy_pct", scalars.pct_change("real", "real_year_ago"))
    rows = cut_lineage(rows.select(*keys, "nominal_yoy_pct", "real_yoy_pct"), "growth")
    a = grouped_median(rows, keys, "nominal_yoy_pct", "nominal_yoy_pct").withColumnRenamed("n", "rows")
    b = grouped_median(rows, keys, "real_yoy_pct", "real_yoy_pct").drop("n")
    return a.join(b, keys)


def case_percentile(growth: DataFrame, cases: DataFrame) -> DataFrame:
    """Growth of each case, the panel median of its month and its percentile rank (average ties).

    The rank is counted against the few case values of each month; the panel is never sorted.
    """
    growth = cut_lineage(growth.select("id", "m", "growth"), "growth")
    chosen = growth.join(cases.select("id"), "id", "left_semi").select("id", "m", F.col("growth").alias("own"))
    others = growth.select("m", "growth").join(chosen, "m")
    counted = others.groupBy("id", "m", "own").agg(
        F.count(F.when(F.col("growth") < F.col("own"), 1)).alias("_below"), F.count(F.when(F.col("growth") == F.col("own"), 1)).alias("_ties"), F.count("*").alias("rows"))
    medians = grouped_median(growth, ["m"], "growth", "panel_median").drop("n")
    return counted.join(medians, "m").select(
        "id", "m", F.col("own").alias("growth"), "panel_median", "rows", (100 * (F.col("_below") + (F.col("_ties") + 1) / 2) / F.col("rows")).alias("percentile"))


def rank_panel(df: DataFrame, month: int, value: str, months_needed: int) -> DataFrame:
    """Signed and absolute competition ranks at one month, in all ids and in the fully observed ids.

    Ranks come from counts per distinct value merged over value ranges, not from one global sort.
    """
    observed = cut_lineage(df.select("id", "m", value).filter(F.col(value).isNotNull()), "observed")
    full = observed.groupBy("id").agg(F.count_distinct("m").alias("_n")).filter(F.col("_n") == months_needed)
    now = observed.filter(F.col("m") == month).select("id", value)
    both = now.withColumn("population", F.lit("available")).unionByName(now.join(full, "id", "left_semi").withColumn("population", F.lit("complete")))
    signed = ranges_rank(both, ["population"], value, "signed_rank")
    absolute = ranges_rank(both.withColumn("_abs", F.abs(F.col(value))), ["population"], "_abs", "absolute_rank").select("population", "id", "absolute_rank")
    return signed.join(absolute, ["population", "id"])


def ranges_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Descending competition rank: equal values are counted first, distinct ones are put into buckets by approximate cut points, and
    an ordered window over the distinct values of one bucket adds the counts above to those of the buckets above."""
    probs = ",".join(repr(i / 256) for i in range(1, 256))
    values = cut_lineage(df.groupBy(*keys, value).agg(F.count("*").alias("_c")), "distinct")
    cuts = values.groupBy(*keys).agg(F.expr(f"approx_percentile({value}, array({probs}), 2000)").alias("_cuts"))
    placed = values.join(cuts, keys).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    before = lambda w: F.coalesce(F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c")).select(*keys, "_b", before(W.partitionBy(*keys).orderBy(F.desc("_b"))).alias("_above"))
    ranked = placed.withColumn("_inside", before(W.partitionBy(*keys, "_b").orderBy(F.desc(value)))).join(per, [*keys, "_b"])
    return df.join(ranked.select(*keys, value, (F.col("_above") + F.col("_inside") + 1).alias(name)), [*keys, value])


def fit_trace(training: DataFrame, keys: list[str]) -> DataFrame:
    return training.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count_distinct("source").alias("dates"), F.max("target").alias("max_training_target"))


def actual_identity(fc: DataFrame) -> DataFrame:
    """Keys whose actual differs between models."""
    return fc.groupBy("id", "origin", "target", "horizon").agg(F.min("actual").alias("a"), F.max("actual").alias("b"), F.count("*").alias("models")).filter("a <> b")


def metric_mismatches(saved: DataFrame, recomputed: DataFrame, keys: list[str], columns: list[str], tolerance: float) -> DataFrame:
    renamed = recomputed.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.col(c).isNull() & F.col(f"_{c}").isNull())
    return saved.join(renamed, keys, "full_outer").filter(bad)


def select_cases(panel: DataFrame, lookup: DataFrame, year: int, group: str) -> DataFrame:
    """One illustrative id per group by training-year mean; forecast errors play no part."""
    means = panel.filter(F.col("m").between(12 * year, 12 * year + 11)).join(
        prep.cohort_complete(panel, year), "id", "left_semi").groupBy("id").agg(F.avg("value").alias("expense"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("expense"), "id"))
    return means.join(lookup, "id").withColumn("_k", rank).filter("_k = 1").drop("_k")


def case_gap(growth: DataFrame, first: int, second: int) -> DataFrame:
    """Growth of two ids and their difference in points, per month."""
    pick = lambda i: F.max(F.when(F.col("id") == i, 100 * F.col("growth")))
    return growth.filter(F.col("id").isin(first, second)).groupBy("m").agg(pick(first).alias("first_pct"), pick(second).alias("second_pct")).withColumn(
        "gap_pp", F.col("first_pct") - F.col("second_pct"))


def seed_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(*aggs)
