"""Pooled regressions of log growth by histogram boosting, every origin and horizon in one job.

Features of a month read nothing after it, so one table of them serves all origins; a model's rows are those whose target is known at its
origin. Missing optional features stay missing.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions import months, scalars
from tidepanel.operators import boosting, joins, prep, profiles
from tidepanel.operators.boosting import Boost
from tidepanel.operators.quantiles import grouped_median
from tidepanel.session import cut_lineage

BASIC = ["log_level", "growth", "growth_lag", "target_sin", "target_cos"]
DIRECT = ["log_level", "growth", "growth_lag", "log_mean", "origin_sin", "origin_cos", "target_sin", "target_cos"]


def growth_features(panel: DataFrame, until: int | None = None) -> DataFrame:
    """(id, m, log_level, growth, growth_lag, log_mean): three positive consecutive months ending at m."""
    known = panel if until is None else panel.filter(F.col("m") <= until)
    s = prep.series(known)
    logs = F.transform("vals", lambda x: F.log(scalars.positive_or_null(x)))
    rows = s.withColumn("logs", logs).filter(F.size("vals") >= 3).select("id", "start", "logs", F.explode(F.sequence(F.col("start") + 2, F.col("stop"))).alias("m"))
    at = lambda k: F.get("logs", (F.col("m") - k - F.col("start")).cast("int"))
    out = rows.select("id", "m", at(0).alias("log_level"), (at(0) - at(1)).alias("growth"), (at(1) - at(2)).alias("growth_lag"), ((at(0) + at(1) + at(2)) / 3).alias("log_mean"))
    return out.filter("log_level is not null and growth is not null and growth_lag is not null")


def training_rows(panel: DataFrame, first: int, fit_origin: int, horizon: int) -> DataFrame:
    """(id, source, target): unbroken history first…source, an observed target not after the fit origin.

    Gaps between source and target do not matter.
    """
    known = panel.filter(F.col("m") <= fit_origin)
    through = prep.complete_through(known, first)
    sources = through.filter(F.col("complete_through") >= first + 2).select(
        "id", F.explode(F.sequence(F.lit(first + 2), F.least(F.col("complete_through"), F.lit(fit_origin - horizon)))).alias("source")) if fit_origin - horizon >= first + 2 else None
    if sources is None:
        return known.select("id", F.col("m").alias("source"), F.col("m").alias("target")).limit(0)
    seen = known.filter("value > 0").select("id", F.col("m").alias("target"))
    return sources.withColumn("target", F.col("source") + horizon).join(seen, ["id", "target"]).select("id", "source", "target")


def context_features(panel: DataFrame, regions: DataFrame, until: int) -> DataFrame:
    """(id, m, global_growth, regional_growth): median log growth of the month, panel and region."""
    g = growth_features(panel, until).select("id", "m", "growth").join(regions.select("id", "region"), "id", "left")
    overall = grouped_median(g, ["m"], "growth", "global_growth").drop("n")
    regional = grouped_median(g.filter("region is not null"), ["region", "m"], "growth", "regional_growth").drop("n")
    return g.join(overall, "m").join(regional, ["region", "m"], "left").select("id", "m", "global_growth", F.coalesce("regional_growth", "global_growth").alias("regional_growth"))


def category_growth(category_panel: DataFrame, categories: list[str]) -> DataFrame:
    """(id, m, g_<category>…): log growth of each category over the last month, NULL unless both months are positive."""
    s = prep.series(category_panel.filter(F.col("category").isin(categories)), ["id", "category"])
    rows = s.select("id", "category", "start", "vals", F.explode(F.sequence("start", "stop")).alias("m"))
    value = lambda k: scalars.positive_or_null(prep.at(F.col("m") - k))
    g = rows.withColumn("g", F.log(value(0) / value(1)))
    return g.groupBy("id", "m").agg(*[F.max(F.when(F.col("category") == c, F.col("g"))).alias(f"g_{c}") for c in categories])


def _phase(m: Column, prefix: str) -> list[Column]:
    return list(scalars.season_phase(months.month_of_year(m), prefix).values())


def direct_rows(panel: DataFrame, regions: DataFrame, first: int, origins: list[int], horizons: list[int], context: bool = False, neighbors: DataFrame | None = None, k: int = 5,
                category_panel: DataFrame | None = None, categories: list[str] | None = None) -> DataFrame:
    """(id, source, horizon, log_source, x, y): features of every month up to the last origin, y NULL where a row cannot be trained on.

    y is the log growth to source + horizon. It needs an unbroken history first…source and an observed target; gaps between them do not
    matter. Whether a target is known at an origin is for the caller to ask.
    """
    last = max(origins)
    known = panel.filter(F.col("m") <= last)
    feats = growth_features(known)
    optional = []
    if context:
        feats = feats.join(context_features(known, regions, last), ["id", "m"], "left")
        optional += ["global_growth", "regional_growth"]
    if category_panel is not None:
        feats = feats.join(category_growth(category_panel.filter(F.col("m") <= last), categories), ["id", "m"], "left")
        optional += [f"g_{c}" for c in categories]
    if neighbors is not None:
        feats = feats.join(joins.neighbor_features(known, neighbors, k), ["id", "m"], "left")
        optional += ["neighbor_growth", "neighbor_growth_lag", "neighbor_spikes", "neighbor_valid"]
    logs = known.select("id", F.col("m").alias("target"), F.log(scalars.positive_or_null("value")).alias("log_target"))
    rows = feats.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("target", F.col("m") + F.col("horizon"))
    rows = rows.join(prep.complete_through(known, first), "id", "left").join(logs, ["id", "target"], "left")
    x = F.array(*[F.col(c) for c in DIRECT[:4]], *_phase(F.col("m"), "origin"), *_phase(F.col("target"), "target"), *[F.col(c) for c in optional])
    usable = (F.col("m") >= first + 2) & (F.col("m") <= F.col("complete_through"))
    return rows.select("id", F.col("m").alias("source"), "horizon", F.col("log_level").alias("log_source"), x.alias("x"),
                       F.when(usable, F.col("log_target") - F.col("log_level")).alias("y"))


def _per_origin(rows: DataFrame, origins: list[int]) -> DataFrame:
    """Each trainable row once for every origin that knows its target."""
    known = F.filter(F.array(*[F.lit(o) for o in origins]), lambda o: o >= F.col("source") + F.col("horizon"))
    return rows.filter("y is not null").withColumn("origin", F.explode(known))


def _blocks_per_origin(rows: DataFrame, origins: list[int]) -> DataFrame:
    """``_per_origin`` of packed rows: they are packed by horizon and source once, and only blocks meet the origins."""
    return _per_origin(cut_lineage(boosting.pack(rows, ["horizon", "source"]), "boost-blocks"), origins)


def fit_audit(rows: DataFrame, origins: list[int], minimum_rows: int = 200) -> DataFrame:
    """(origin, horizon, rows, ids, max_target, status) of every model that ``direct_rows`` can train.

    An id counts from its first known target on, so rows are counted once by month and only these counts meet the origins.
    """
    known = rows.filter("y is not null").groupBy("id", "horizon").agg(F.collect_list(F.col("source") + F.col("horizon")).alias("targets"))
    every = F.transform("targets", lambda t: F.struct(t.alias("target"), F.lit(1).alias("n"), F.lit(0).alias("first")))
    once = F.array(F.struct(F.array_min("targets").alias("target"), F.lit(0).alias("n"), F.lit(1).alias("first")))
    counts = known.select("horizon", F.inline(F.concat(every, once))).groupBy("horizon", "target").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    reach = F.filter(F.array(*[F.lit(o) for o in origins]), lambda o: o >= F.col("target"))
    return counts.withColumn("origin", F.explode(reach)).groupBy("origin", "horizon").agg(
        F.sum("n").alias("rows"), F.sum("first").alias("ids"), F.max("target").alias("max_target")).withColumn(
        "status", F.when(F.col("rows") >= minimum_rows, "trained").otherwise("seasonal_fallback"))


def fit_direct_horizon(panel: DataFrame, regions: DataFrame, first: int, origins: list[int], horizons: list[int], context: bool = False, neighbors: DataFrame | None = None,
                       k: int = 5, minimum_rows: int = 200, settings: Boost = Boost(), limit: float = 1.0, category_panel: DataFrame | None = None,
                       categories: list[str] | None = None, task_rows: int | None = None, variants: dict[str, int | None] | None = None) -> DataFrame:
    """One model per (origin, horizon) of the cumulative log growth, clipped; all are fitted in one job.

    Below ``minimum_rows`` training rows the pooled seasonal forecast is used and labelled as such; before the end of its profile year
    there is none and no row. ``variants`` names models by how many of the features they read, from the first on (None: all); they share one
    table of rows and the job, and a column ``variant`` tells them apart.
    """
    keys = ["variant", "origin", "horizon"]
    rows = cut_lineage(direct_rows(panel, regions, first, origins, horizons, context, neighbors, k, category_panel, categories), "direct-rows")
    every = F.array(*[F.struct(F.lit(name).alias("variant"), F.lit(width).cast("int").alias("features")) for name, width in (variants or {"": None}).items()])
    of_variant = lambda df: df.withColumn("_v", F.explode(every)).withColumns({
        "variant": F.col("_v.variant"), "x": F.slice("x", F.lit(1), F.coalesce("_v.features", F.size("x")))}).drop("_v")
    train = _blocks_per_origin(rows, origins)
    enough = train.groupBy("origin", "horizon").agg(F.sum("rows").alias("_rows")).filter(F.col("_rows") >= minimum_rows).drop("_rows")
    train = of_variant(train.join(F.broadcast(enough), ["origin", "horizon"], "left_semi")).withColumn("width", F.size("x"))
    models = boosting.fit_packed(train, keys, settings, task_rows)
    applied = rows.filter(F.col("source").isin(origins)).select("id", F.col("source").alias("origin"), "horizon", "log_source", "x")
    scored = boosting.predict(of_variant(applied), keys, boosting.forests(models, keys))
    p = profiles.profile_global(panel.filter(F.col("m") <= max(origins)), first // 12)
    scored = scored.join(F.broadcast(p))  # twelve factors
    target = F.col("origin") + F.col("horizon")
    seasonal = F.when(F.col("origin") >= first + 11, F.exp("log_source") * profiles.factor("p_global", target) / profiles.factor("p_global", F.col("origin")))
    trained = F.exp(F.col("log_source") + scalars.clip("raw", -limit, limit))
    return scored.select("id", "origin", target.alias("target"), "horizon", F.when(F.col("raw").isNotNull(), "trained").otherwise("seasonal_fallback").alias("status"),
                         F.coalesce(trained, seasonal).alias("predicted"), *(["variant"] if variants else [])).filter("predicted is not null")


def fit_spatial(panel, regions, neighbors, first, origins, k: int = 5, **kw) -> DataFrame:
    """One-step direct model with and without neighbour features."""
    return fit_direct_horizon(panel, regions, first, origins, [1], neighbors=neighbors, k=k, variants={"plain": len(DIRECT), "neighbors": None}, **kw)


def fit_recursive_growth(panel: DataFrame, origins: list[int], steps: int, profile: DataFrame | None = None, settings: Boost = Boost(), limit: float = 0.5,
                         task_rows: int | None = None) -> DataFrame:
    """Pooled model of next month's log growth for each origin, applied ``steps`` times to its own output.

    With ``profile`` (one row, array ``p_global``) levels are divided by the profile first and multiplied back at the target. An origin
    without training rows has no forecasts.
    """
    if steps < 1:
        raise ValueError("at least one step")
    known = panel.filter(F.col("m") <= max(origins))
    if profile is not None:
        known = known.crossJoin(F.broadcast(profile)).select("id", "m", (F.col("value") / profiles.factor("p_global", "m")).alias("value"))
    feats = cut_lineage(growth_features(known), "features")
    ahead = feats.select("id", (F.col("m") - 1).alias("m"), F.col("growth").alias("y"))
    phases = profile is None
    x = F.array(*[F.col(c) for c in BASIC[:3]], *(_phase(F.col("m") + 1, "target") if phases else []))
    rows = feats.join(ahead, ["id", "m"]).select("id", F.col("m").alias("source"), F.lit(1).alias("horizon"), x.alias("x"), "y")
    fitted = boosting.forests(boosting.fit_packed(_blocks_per_origin(rows, origins), ["origin"], settings, task_rows), ["origin"])
    angle = 2 * np.pi / 12

    def roll(batches):
        for batch in boosting.gathered(batches):
            origin, level, growth, lag = (batch.column(c).to_numpy() for c in ("origin", "log_level", "growth", "growth_lag"))
            path = np.full((len(origin), steps), np.nan)
            for o in np.unique(origin):
                own = np.flatnonzero(origin == o)
                if (model := fitted.get((int(o),))) is None:
                    continue
                now, g, before = level[own], growth[own], lag[own]
                for h in range(steps):
                    moy = (int(o) + 1 + h) % 12 + 1
                    season = [np.full(len(own), f(angle * moy)) for f in (np.sin, np.cos)] if phases else []
                    g, before = np.clip(model(np.column_stack([now, g, before, *season])), -limit, limit), g
                    now = now + g
                    path[own, h] = now
            paths = pa.ListArray.from_arrays(np.arange(0, path.size + 1, steps, np.int32), path.ravel())
            yield from pa.table([batch.column("id"), batch.column("origin"), paths], ["id", "origin", "path"]).to_batches(10_000)

    kinds = {f.name: f.dataType.simpleString() for f in feats.schema.fields}
    state = feats.filter(F.col("m").isin(origins)).select("id", F.col("m").cast("int").alias("origin"), "log_level", "growth", "growth_lag")
    # an origin's rows meet, as its model scores many together
    out = state.repartition("origin").mapInArrow(roll, f"id {kinds['id']}, origin int, path array<double>").select("id", "origin", F.posexplode("path").alias("_h", "_level")).filter(~F.isnan("_level"))
    out = out.select("id", "origin", (F.col("origin") + F.col("_h") + 1).alias("target"), (F.col("_h") + 1).alias("horizon"), F.exp("_level").alias("predicted"))
    if profile is not None:
        out = out.crossJoin(F.broadcast(profile)).withColumn("predicted", F.col("predicted") * profiles.factor("p_global", "target")).drop("p_global")
    return out


def fit_residual_correction(fc: DataFrame, panel: DataFrame, origin: int, kind: str = "ridge", penalty: float = 100.0, settings: Boost = Boost(l2=10.0), limit: float = 0.5,
                            extra: DataFrame | None = None) -> DataFrame:
    """Correct seasonal forecasts of every horizon by a model of ln(actual / forecast) on the id's own features.

    ``extra`` (id, m, features…) adds features known at the origin of a forecast, such as ``category_growth`` or a policy rate. Trained
    on targets up to ``origin`` only, applied to later origins. The ridge takes 0 and an indicator for a missing feature.
    """
    rows = fc.filter("predicted > 0").join(growth_features(panel).withColumnRenamed("m", "origin"), ["id", "origin"]).withColumn("y", scalars.log_ratio("actual", "predicted"))
    columns = ["log_level", "growth", "growth_lag", "log_mean"]
    if extra is not None:
        rows = rows.join(extra.withColumnRenamed("m", "origin"), ["id", "origin"], "left")
        columns += [c for c in extra.columns if c not in ("id", "m")]
    if rows.select("horizon").distinct().limit(2).count() > 1:
        columns.append("horizon")
    names = [f"f{i}" for i in range(len(columns))]
    rows = cut_lineage(rows.select("id", "origin", "target", "horizon", "actual", F.col("predicted").alias("base"), "y", *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)]), "residual-rows")
    train = rows.filter(F.col("target") <= origin)
    later = rows.filter(F.col("origin") >= origin)
    if kind == "ridge":
        given = names[4:4 + len(extra.columns) - 2] if extra is not None else []
        fill = lambda df: df.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in given} | {f"{n}_missing": F.col(n).isNull().cast("double") for n in given})
        assembler = VectorAssembler(inputCols=[*names, *[f"{n}_missing" for n in given]], outputCol="features")
        model = LinearRegression(featuresCol="features", labelCol="y", predictionCol="raw", regParam=penalty, elasticNetParam=0.0, standardization=True).fit(assembler.transform(fill(train)))
        scored = model.transform(assembler.transform(fill(later))).drop("features")
    else:
        keyed = lambda df: df.withColumn("x", F.array(*names)).withColumn("model", F.lit(0))
        scored = boosting.predict(keyed(later), ["model"], boosting.forests(boosting.fit(keyed(train), ["model"], settings), ["model"]))
    return scored.select("id", "origin", "target", "horizon", "actual", "base", (F.col("base") * F.exp(scalars.clip("raw", -limit, limit))).alias("predicted"))
