"""Panel preparation: cutoffs, cohorts, densification, coverage, deterministic samples.

A panel is long: (id[, category], m, value). Per-id work uses ``series``, one dense array per id over
its own month span, so that any number of lagged look-ups costs a single shuffle by id.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepanel.functions import months, scalars
from tidepanel.operators import guards
from tidepanel.operators.quantiles import grouped_quantile


# -- cutoffs ------------------------------------------------------------------------------------
def normalize_month(df: DataFrame, column: str) -> DataFrame:
    out = df.withColumn("m", months.parse_month(column))
    guards.assert_empty(out.filter("m is null"), f"{column}: not a month")
    return out


def exclude_future(panel: DataFrame, origin: int) -> DataFrame:
    return panel.filter(F.col("m") <= origin)


def available_as_of(panel: DataFrame, as_of, column: str = "available_from") -> DataFrame:
    """Rows public at ``as_of``; an unknown availability date is an error, not an assumption."""
    guards.assert_empty(panel.filter(F.col(column).isNull()), f"{column} must be set for every row")
    return panel.filter(F.col(column) <= F.lit(as_of).cast("date"))


def cutoff_counts(panel: DataFrame, origin: int, as_of=None) -> DataFrame:
    """Rows dropped by each cutoff, in one pass."""
    future = F.col("m") > origin
    late = F.lit(False) if as_of is None else (~future & (F.col("available_from") > F.lit(as_of).cast("date")))
    return panel.agg(
        F.count("*").alias("rows"), F.count(F.when(future, 1)).alias("future_rows"),
        F.count(F.when(late, 1)).alias("unavailable_rows"),
        F.count(F.when(~future & ~late, 1)).alias("kept_rows"))


# -- shape --------------------------------------------------------------------------------------
def densify(panel: DataFrame, first: int, last: int, keys: list[str] | None = None) -> DataFrame:
    """Full id × month grid; missing months become rows with a NULL value."""
    keys = keys or ["id"]
    grid = panel.select(*keys).distinct().withColumn("m", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.join(panel.filter(F.col("m").between(first, last)), [*keys, "m"], "left")


def to_wide(panel: DataFrame, month_range: range) -> DataFrame:
    return panel.groupBy("id").pivot("m", list(month_range)).agg(F.first("value"))


def to_long(wide: DataFrame, value: str = "value") -> DataFrame:
    columns = [c for c in wide.columns if c != "id"]
    return wide.unpivot("id", columns, "m", value).withColumn("m", F.col("m").cast("int"))


def series(panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, start, vals: dense array from the first to the last observed month of each id."""
    keys = keys or ["id"]
    grouped = panel.groupBy(*keys).agg(
        F.min("m").alias("start"), F.max("m").alias("stop"),
        F.map_from_entries(F.collect_list(F.struct("m", scalars.finite_or_null("value").alias("value")))).alias("_map"))
    dense = F.transform(F.sequence("start", "stop"), lambda m: F.element_at("_map", m))
    return grouped.select(*keys, "start", "stop", dense.alias("vals"))


def at(m, vals="vals", start="start") -> Column:
    """Value of a series at month index ``m``; NULL outside its span."""
    m = F.col(m) if isinstance(m, str) else m
    return F.get(F.col(vals), (m - F.col(start)).cast("int"))


# -- cohorts ------------------------------------------------------------------------------------
def _positive_count(panel: DataFrame, keys, first: int, last: int) -> DataFrame:
    inside = panel.filter(F.col("m").between(first, last))
    good = scalars.positive_or_null("value").isNotNull()
    return inside.groupBy(*keys).agg(F.count(F.when(good, 1)).alias("n"))


def cohort_complete(panel: DataFrame, year: int, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["id"]
    return _positive_count(panel, keys, 12 * year, 12 * year + 11).filter("n = 12").select(*keys)


def cohort_balanced(panel: DataFrame, first: int, last: int, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["id"]
    return _positive_count(panel, keys, first, last).filter(F.col("n") == last - first + 1).select(*keys)


def cohort_observed_through(panel: DataFrame, first: int, until: int) -> DataFrame:
    """Complete up to the calibration end only; later months do not matter."""
    return cohort_balanced(panel, first, until)


def cohort_fixed_across(panel: DataFrame, total: str, year: int) -> DataFrame:
    """Cohort frozen on the total category, intersected with each category's own completeness."""
    frozen = cohort_complete(panel.filter(F.col("category") == total), year)
    own = cohort_complete(panel, year, ["category", "id"])
    return own.join(frozen, "id", "left_semi")


def complete_through(panel: DataFrame, first: int, keys: list[str] | None = None) -> DataFrame:
    """Last month of the unbroken positive run that starts at ``first`` (absent if it never starts)."""
    keys = keys or ["id"]
    good = panel.filter((F.col("m") >= first) & scalars.positive_or_null("value").isNotNull())
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("m"))
    return (
        good.withColumn("_k", rank).filter(F.col("m") - F.col("_k") == first - 1)
        .groupBy(*keys).agg(F.max("m").alias("complete_through"))
    )


def prefix_complete(panel: DataFrame, first: int) -> DataFrame:
    """(id, origin) pairs whose whole history first…origin is finite and positive."""
    return complete_through(panel, first).select(
        "id", F.explode(F.sequence(F.lit(first), "complete_through")).alias("origin"))


def active_across_categories(panel: DataFrame, first: int, categories: int) -> DataFrame:
    """Last month through which every category of an id is complete."""
    per = complete_through(panel, first, ["id", "category"])
    return per.groupBy("id").agg(F.count("*").alias("n"), F.min("complete_through").alias("active_through")).filter(
        F.col("n") == categories).select("id", "active_through")


def evaluation_pairs(panel: DataFrame, year: int, horizons, last: int) -> DataFrame:
    """Every (id, origin, horizon) of the cohort with one exclusive reason.

    Origins run from the end of the profile year; targets up to ``last``.
    """
    first = 12 * year
    s = series(panel).join(cohort_complete(panel, year), "id", "left_semi")
    s = s.join(complete_through(panel, first), "id", "left")
    rows = (
        s.select("id", "start", "vals", "complete_through",
                 F.explode(F.sequence(F.lit(first + 11), F.lit(last - 1))).alias("origin"))
        .withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
        .withColumn("target", F.col("origin") + F.col("horizon"))
        .filter(F.col("target") <= last)
    )
    target_ok = scalars.positive_or_null(at("target")).isNotNull()
    reason = (
        F.when(F.col("complete_through").isNull() | (F.col("complete_through") < F.col("origin")), "missing_history")
        .when(~target_ok, "missing_target").otherwise("retained"))
    return rows.select("id", "origin", "target", "horizon", reason.alias("reason"))


# -- samples ------------------------------------------------------------------------------------
def sample_ids(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """Fixed sample without replacement, in hash order: a top-n, never a full sort."""
    return ids.select("id").orderBy(scalars.id_uniform(F.lit(seed), "id"), "id").limit(n)


def assign_treated(ids: DataFrame, seed: int, fraction: float = 0.25) -> DataFrame:
    """Assignment that depends on the id alone, so it is stable across cohorts."""
    return ids.withColumn("treated", scalars.id_uniform(F.lit(seed), "id") < fraction)


def sample_per_group(ids: DataFrame, sampled: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Up to k ids for each group that has no sampled id yet."""
    covered = ids.join(sampled, "id", "left_semi").select(group).distinct()
    rank = F.row_number().over(W.partitionBy(group).orderBy(scalars.id_uniform(F.lit(seed), "id"), "id"))
    return ids.join(covered, group, "left_anti").withColumn("_k", rank).filter(F.col("_k") <= k).drop("_k")


# -- coverage -----------------------------------------------------------------------------------
def coverage_by_month(panel: DataFrame, cohorts: dict[str, DataFrame], first: int, last: int) -> DataFrame:
    """Observed and missing ids per cohort and month, in one pass over the panel."""
    inside = panel.filter(F.col("m").between(first, last) & F.col("value").isNotNull())
    parts = []
    for name, ids in cohorts.items():
        members = ids.agg(F.count("*").alias("members"))
        seen = inside.join(ids, "id", "left_semi").groupBy("m").agg(F.count("*").alias("observed"))
        grid = members.withColumn("m", F.explode(F.sequence(F.lit(first), F.lit(last))))
        parts.append(grid.join(seen, "m", "left").select(
            F.lit(name).alias("cohort"), "m", F.coalesce("observed", F.lit(0)).alias("observed"),
            (F.col("members") - F.coalesce("observed", F.lit(0))).alias("missing")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def coverage_history_target(panel: DataFrame, cohort: DataFrame, first: int, targets: range, delay: int) -> DataFrame:
    """Per target: ids with a complete history at the delayed origin, and those scored."""
    through = complete_through(panel, first)
    s = cohort.join(series(panel), "id", "left").join(through, "id", "left")
    rows = s.withColumn("target", F.explode(F.sequence(F.lit(targets.start), F.lit(targets.stop - 1))))
    timing = months.delay_timing("target", F.lit(delay))
    ready = F.coalesce(F.col("complete_through") >= timing["origin"], F.lit(False))
    seen = at("target").isNotNull()
    return rows.groupBy("target").agg(
        F.count("*").alias("ids"),
        F.count(F.when(ready, 1)).alias("history_eligible"),
        F.count(F.when(~ready, 1)).alias("incomplete_history"),
        F.count(F.when(ready & ~seen, 1)).alias("unobserved_target"),
        F.count(F.when(ready & seen, 1)).alias("scored"),
    ).withColumn("origin", timing["origin"]).withColumn("horizon", timing["horizon"])


def lookup_version(lookup: DataFrame, origin_year: int, year: int | None = None) -> DataFrame:
    """Rows of the explicit year, else of the newest year not after the origin."""
    if year is not None:
        if year > origin_year:
            raise ValueError("lookup year must not be later than the origin")
        chosen = lookup.filter(F.col("year") == year)
    else:
        newest = lookup.filter(F.col("year") <= origin_year).agg(F.max("year").alias("year"))
        chosen = lookup.join(F.broadcast(newest), "year", "left_semi")
    guards.assert_unique(chosen, ["id"])
    if chosen.limit(1).count() == 0:
        raise ValueError("no lookup version at or before the origin")
    return chosen


# -- unit attributes ----------------------------------------------------------------------------
def expense_quartiles(panel: DataFrame, year: int) -> DataFrame:
    """(id, expense, quartile) from training-year means; a value on a cut belongs to the lower group."""
    means = (
        panel.filter(F.col("m").between(12 * year, 12 * year + 11))
        .join(cohort_complete(panel, year), "id", "left_semi")
        .groupBy("id").agg(F.avg("value").alias("expense")))
    cuts = grouped_quantile(means, [], "expense", {"c1": 0.25, "c2": 0.5, "c3": 0.75}).drop("n")
    x = F.col("expense")
    label = F.when(x <= F.col("c1"), "Q1").when(x <= F.col("c2"), "Q2").when(x <= F.col("c3"), "Q3").otherwise("Q4")
    return means.crossJoin(F.broadcast(cuts)).select("id", "expense", label.alias("quartile"))


def scale_by_id(panel: DataFrame, year: int) -> DataFrame:
    """Training-year mean and mean absolute monthly change."""
    w = W.partitionBy("id").orderBy("m")
    inside = panel.filter(F.col("m").between(12 * year, 12 * year + 11)).withColumn(
        "_d", F.abs(F.col("value") - F.lag("value").over(w)))
    return inside.groupBy("id").agg(F.avg("value").alias("mean_value"), F.avg("_d").alias("mean_change"))


def label_period(m, early: range, late: range) -> Column:
    m = F.col(m) if isinstance(m, str) else m
    return F.when(m.between(early.start, early.stop - 1), "early").when(
        m.between(late.start, late.stop - 1), "late").otherwise("other")
