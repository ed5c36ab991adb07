"""Per-series trend regressions for every origin at once.

The straight line comes from running sums; only the ridge with Fourier terms needs a grouped map.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidepanel.functions import months, scalars
from tidepanel.operators import profiles


def linear_trend(panel: DataFrame, first: int, minimum: int = 12) -> DataFrame:
    """(id, origin, slope, intercept) of the value on t = m − first, over first…origin."""
    w = W.partitionBy("id").orderBy("m").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = (F.col("m") - first).cast("double")
    rows = panel.filter(F.col("m") >= first).withColumn("y", scalars.finite_or_null("value")).filter("y is not null").withColumn("t", t)
    sums = rows.select(
        "id", F.col("m").alias("origin"), F.count("*").over(w).alias("n"), F.sum("t").over(w).alias("st"), F.sum("y").over(w).alias("sy"),
        F.sum(F.col("t") * F.col("y")).over(w).alias("sty"), F.sum(F.col("t") * F.col("t")).over(w).alias("stt"))
    det = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    slope = (F.col("n") * F.col("sty") - F.col("st") * F.col("sy")) / det
    return sums.filter((F.col("n") >= minimum) & (det > 0)).select(
        "id", "origin", slope.alias("slope"), ((F.col("sy") - slope * F.col("st")) / F.col("n")).alias("intercept"))


def trend_forecasts(rows: DataFrame, trend: DataFrame, first: int) -> DataFrame:
    """``rows`` (id, origin, target, horizon, actual) extended by the line, clipped at zero."""
    return rows.join(trend, ["id", "origin"]).withColumn(
        "predicted", F.greatest(F.col("intercept") + F.col("slope") * (F.col("target") - first), F.lit(0.0))).drop("slope", "intercept")


def profile_trend_forecasts(rows: DataFrame, panel: DataFrame, prof: DataFrame, first: int) -> DataFrame:
    """Line fitted on values divided by the profile, multiplied back at the target."""
    from tidepanel.operators.forecast import deseasonalize, reseasonalize

    flat = deseasonalize(panel, prof)
    return reseasonalize(trend_forecasts(rows, linear_trend(flat, first), first), prof)


def fourier_ridge(panel: DataFrame, first: int, horizons, order: int = 3, penalty: float = 1.0, minimum: int = 12) -> DataFrame:
    """Line plus yearly Fourier terms by ridge regression, per id, for every origin.

    Each id is one small normal-equation problem per origin; Spark spreads the ids.
    """
    hs = [int(h) for h in horizons]

    def design(m):
        t = (m - first) / 12.0
        waves = [f(2 * np.pi * k * m / 12.0) for k in range(1, order + 1) for f in (np.sin, np.cos)]
        return np.column_stack([np.ones_like(t), t, *waves])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("m")
        m, y = pdf["m"].to_numpy(float), pdf["value"].to_numpy(float)
        x = design(m)
        pen = np.diag([0.0, 0.0] + [penalty] * (x.shape[1] - 2))
        gram = np.cumsum(x[:, :, None] * x[:, None, :], axis=0) + pen + 1e-9 * np.eye(x.shape[1])
        moment = np.cumsum(x * y[:, None], axis=0)
        keep = np.arange(len(m)) >= minimum - 1
        if not keep.any():
            return pd.DataFrame({"id": [], "origin": [], "target": [], "horizon": [], "predicted": []})
        beta = np.linalg.solve(gram[keep], moment[keep][:, :, None])[:, :, 0]
        parts = []
        for h in hs:
            target = m[keep] + h
            parts.append(pd.DataFrame({
                "id": int(pdf["id"].iloc[0]), "origin": m[keep].astype(int), "target": target.astype(int), "horizon": h,
                "predicted": np.maximum(0.0, (design(target) * beta).sum(axis=1))}))
        return pd.concat(parts, ignore_index=True)

    rows = panel.filter(F.col("m") >= first).select("id", "m", scalars.finite_or_null("value").alias("value")).filter("value is not null")
    return rows.groupBy("id").applyInPandas(fit, "id long, origin int, target int, horizon int, predicted double")


def forecast_with(panel: DataFrame, origins: list[int], horizons, predict, first: int) -> DataFrame:
    """Hook for a user model: ``predict(histories, horizon) → array`` on batches of equally long histories.

    ``histories`` is a 2-D array of the months first…origin; ids with a gap are left out. Batches follow
    the Arrow record size, so a batch never grows with the data.
    """
    from tidepanel.operators import prep

    hs = [int(h) for h in horizons]
    series = prep.series(panel)
    grid = series.filter(F.col("start") <= first).select(
        "id", "start", "vals", F.explode(F.array(*[F.lit(o) for o in origins])).alias("origin"))
    span = F.slice("vals", F.lit(first + 1) - F.col("start"), F.col("origin") - first + 1)
    grid = grid.withColumn("history", span).filter(
        (F.size("history") == F.col("origin") - first + 1) & ~F.exists("history", lambda x: x.isNull() | (x <= 0))).select("id", "origin", "history")

    def run(batches):
        for pdf in batches:
            for origin, part in pdf.groupby("origin"):
                block = np.vstack(part["history"].to_numpy())
                path = np.asarray(predict(block, max(hs)), dtype=float)
                for h in hs:
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "origin": int(origin), "target": int(origin) + h, "horizon": h,
                                        "predicted": np.maximum(0.0, path[:, h - 1])})

    return grid.mapInPandas(run, "id long, origin int, target int, horizon int, predicted double")
