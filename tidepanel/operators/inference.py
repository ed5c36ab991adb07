"""Resampling and tests on paired losses. Draws come from hashes, so they repeat on any cluster."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidepanel.functions import scalars
from tidepanel.operators.quantiles import grouped_quantile
from tidepanel.session import cut_lineage


def numbered(df: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """0…n−1 by (hash bucket, key): offsets come from bucket counts, so no task orders all keys."""
    placed = df.withColumn("_b", F.floor(scalars.id_uniform(F.lit("n"), key) * buckets))
    offsets = placed.groupBy("_b").agg(F.count("*").alias("_c")).withColumn(
        "_off", F.coalesce(F.sum("_c").over(W.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("_b").orderBy(key))
    return placed.withColumn("_i", inside).join(offsets.select("_b", "_off"), "_b").withColumn("idx", F.col("_off") + F.col("_i") - 1).drop("_b", "_i", "_off")


def _draws(sizes: DataFrame, keys: list[str], draws: int, seed: int) -> DataFrame:
    """(keys, draw, idx, w): how often each draw picks each of n units."""
    # ``sizes`` has one row a horizon at most; the draws are a range that Spark spreads over its tasks.
    spread = sizes.sparkSession.range(0, draws, 1, max(2, sizes.sparkSession.sparkContext.defaultParallelism)).select(F.col("id").cast("int").alias("draw"))
    grid = spread.crossJoin(F.broadcast(sizes)).withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    u = scalars.id_uniform(F.lit(seed), F.concat_ws(":", F.col("draw").cast("string"), F.col("slot").cast("string")))
    return grid.select(*keys, "draw", F.floor(u * F.col("n")).alias("idx")).groupBy(*keys, "draw", "idx").agg(F.count("*").alias("w"))


def bootstrap_dates(pairs: DataFrame, draws: int, seed: int) -> DataFrame:
    """95 % interval of the mean date-level gain of b over a, resampling target dates."""
    gains = pairs.groupBy("horizon", "target").agg(F.avg(F.col("loss_a") - F.col("loss_b")).alias("gain"))
    # One row per target month and horizon: the calendar bounds this window.
    gains = cut_lineage(gains, "date-gains").withColumn("idx", F.row_number().over(W.partitionBy("horizon").orderBy("target")) - 1)
    sizes = gains.groupBy("horizon").agg(F.count("*").alias("n"), F.avg("gain").alias("mean_gain"))
    picked = _draws(sizes.select("horizon", "n"), ["horizon"], draws, seed).join(gains, ["horizon", "idx"])
    means = picked.groupBy("horizon", "draw").agg((F.sum(F.col("gain") * F.col("w")) / F.sum("w")).alias("x"))
    q = grouped_quantile(means, ["horizon"], "x", {"low": 0.025, "high": 0.975}).drop("n")
    return sizes.join(q, "horizon").select("horizon", F.col("n").alias("dates"), "mean_gain", "low", "high")


def bootstrap_clusters(pairs: DataFrame, clusters: DataFrame, cluster: str, draws: int, seed: int) -> DataFrame:
    """95 % interval of the date-balanced difference and reduction, resampling whole clusters.

    Rows are summed to cluster × date first. Every draw recomputes the denominator of each date, so an
    unbalanced panel keeps its weights; a draw that leaves a date empty is dropped and counted.
    """
    cells = pairs.join(clusters.select("id", cluster), "id").groupBy("horizon", cluster, "target").agg(
        F.sum("loss_a").alias("a"), F.sum("loss_b").alias("b"), F.count("*").alias("n"))
    # Four parts of the plan read these sums; written once, they replace four passes over the losses.
    cells = cut_lineage(cells, "cluster-sums")
    units = numbered(cells.select(cluster).distinct(), cluster)
    size = units.agg(F.count("*").alias("n"))
    weights = _draws(size, [], draws, seed).join(units, "idx").select("draw", cluster, "w")
    per_date = cells.join(weights, cluster).groupBy("horizon", "draw", "target").agg(
        F.sum(F.col("a") * F.col("w")).alias("a"), F.sum(F.col("b") * F.col("w")).alias("b"), F.sum(F.col("n") * F.col("w")).alias("n"))
    expected = cells.groupBy("horizon").agg(F.count_distinct("target").alias("dates"))
    stat = per_date.groupBy("horizon", "draw").agg(F.avg(F.col("a") / F.col("n")).alias("a"), F.avg(F.col("b") / F.col("n")).alias("b"), F.count("*").alias("_d"))
    stat = stat.join(expected, "horizon").filter("_d = dates").withColumn("difference", F.col("b") - F.col("a")).withColumn("reduction", 100 * (1 - F.col("b") / F.col("a")))
    d = grouped_quantile(stat, ["horizon"], "difference", {"difference_low": 0.025, "difference_high": 0.975}).withColumnRenamed("n", "draws")
    r = grouped_quantile(stat, ["horizon"], "reduction", {"reduction_low": 0.025, "reduction_high": 0.975}).drop("n")
    return d.join(r, "horizon")


_BUCKETS, _BLOCK = 1024, 256
_MONTHS = 1 << 32  # months are below it, so horizon and month make one number


def bucket_shares(sizes: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """(draws, buckets): how many picks of each draw fall to each bucket. It costs draws × buckets, so a task makes it once for all its buckets."""
    return np.random.default_rng([seed, 0]).multinomial(int(sizes.sum()), sizes / sizes.sum(), size=draws)


def unit_weights(sizes: np.ndarray, bucket: int, draws: int, seed: int, shares: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """How often each draw picks each unit of a bucket, unit by unit; a draw picks as many units as there are in all buckets.

    The picks of a draw are split over the buckets, then over the units of a bucket one after the other: a unit gets a binomial share of what
    is left, the last one the rest. That is drawing with replacement, without a row for a pick. Generators are seeded by bucket.
    """
    left = (bucket_shares(sizes, draws, seed) if shares is None else shares)[:, bucket]
    own = np.random.default_rng([seed, 1, bucket])
    for k in range(int(sizes[bucket]), 0, -1):
        w = own.binomial(left, 1 / k) if k > 1 else left
        left = left - w
        yield w


def bootstrap_units(pairs: DataFrame, draws: int, seed: int, unit: str = "id") -> DataFrame:
    """``bootstrap_clusters`` with as many clusters as there are ids: 95 % intervals from arrays over draws, never draws × ids rows.

    Rows of a bucket stream through a task in the order of units, and blocks of units are folded into one array a date by matrix products.
    What a task keeps and emits is dates × draws numbers, whatever the number of ids.
    """
    cells = pairs.groupBy("horizon", unit, "target").agg(F.sum("loss_a").alias("a"), F.sum("loss_b").alias("b"), F.count("*").cast("double").alias("n"))
    cells = cut_lineage(cells.select(F.pmod(F.xxhash64(unit), F.lit(_BUCKETS)).cast("int").alias("bucket"), F.col(unit).alias("unit"), "horizon", "target", "a", "b", "n"), "unit-sums")
    sizes = np.zeros(_BUCKETS, np.int64)
    for r in cells.groupBy("bucket").agg(F.count_distinct("unit").alias("n")).collect():
        sizes[r["bucket"]] = r["n"]
    dates = sorted((r["horizon"], r["target"]) for r in cells.select("horizon", "target").distinct().collect())  # the calendar
    codes = np.array([h * _MONTHS + t for h, t in dates])  # rising, as dates are

    def run(batches):
        total, shares = np.zeros((3, len(dates), draws)), None
        weights, current, held = None, None, []
        block = np.zeros((3, len(dates), _BLOCK))

        def flush():
            nonlocal held, block
            if held:
                for k in range(3):
                    total[k] += block[k][:, :len(held)] @ np.array(held, float)
                held, block = [], np.zeros_like(block)

        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            bucket, own = column["bucket"].to_numpy(), column["unit"].dictionary_encode("encode").indices.to_numpy()
            place = np.searchsorted(codes, column["horizon"].to_numpy().astype(np.int64) * _MONTHS + column["target"].to_numpy())
            sums = np.array([column[c].to_numpy(zero_copy_only=False) for c in "abn"])
            starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1])]))
            for first, last in zip(starts, [*starts[1:], batch.num_rows]):
                name = int(bucket[first]), column["unit"][int(first)].as_py()
                if current is None or current[0] != name[0]:
                    shares = bucket_shares(sizes, draws, seed) if shares is None else shares
                    weights = unit_weights(sizes, name[0], draws, seed, shares)
                if current != name:
                    if len(held) == _BLOCK:
                        flush()
                    current = name
                    held.append(next(weights))
                block[:, place[first:last], len(held) - 1] = sums[:, first:last]
        flush()
        flat = lambda k: pa.array(list(total[k]), pa.list_(pa.float64()))
        yield pa.record_batch([pa.array([h for h, _ in dates], pa.int32()), pa.array([t for _, t in dates], pa.int32()), flat(0), flat(1), flat(2)], ["horizon", "target", "a", "b", "n"])

    arrays = "a array<double>, b array<double>, n array<double>"
    parts = cells.repartition("bucket").sortWithinPartitions("bucket", "unit").mapInArrow(run, f"horizon int, target int, {arrays}")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = {c: np.vstack(pdf[c].to_numpy()).sum(axis=0) for c in "abn"}
        return pd.DataFrame({"horizon": pdf["horizon"].iloc[:1], "target": pdf["target"].iloc[:1], **{c: [v] for c, v in sums.items()}})

    def balanced(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, n = (np.vstack(pdf[c].to_numpy()) for c in "abn")
        ok = (n > 0).all(axis=0)  # a draw that leaves a date empty is dropped
        mean = lambda x: (x[:, ok] / n[:, ok]).mean(axis=0)
        return pd.DataFrame({"horizon": pdf["horizon"].iloc[0], "draw": np.flatnonzero(ok), "a": mean(a), "b": mean(b)})

    by_date = parts.groupBy("horizon", "target").applyInPandas(joined, f"horizon int, target int, {arrays}")  # one row a task
    # Both quantiles read the draws of a horizon; written once, the weights are not drawn again.
    stat = cut_lineage(by_date.groupBy("horizon").applyInPandas(balanced, "horizon int, draw long, a double, b double"), "draws")
    stat = stat.withColumn("difference", F.col("b") - F.col("a")).withColumn("reduction", 100 * (1 - F.col("b") / F.col("a")))
    d = grouped_quantile(stat, ["horizon"], "difference", {"difference_low": 0.025, "difference_high": 0.975}).withColumnRenamed("n", "draws")
    r = grouped_quantile(stat, ["horizon"], "reduction", {"reduction_low": 0.025, "reduction_high": 0.975}).drop("n")
    return d.join(r, "horizon")


def dm_test(pairs: DataFrame) -> DataFrame:
    """Small-sample corrected Diebold–Mariano statistic per horizon with Bartlett weights up to lag h − 1.

    Too few dates (fewer than max(8, 2h + 1)) or a degenerate variance give NULL with a status.
    """
    dates = pairs.groupBy("horizon", "target").agg(F.avg(F.col("loss_b") - F.col("loss_a")).alias("d"))
    # One value per target month: the array is bounded by the calendar.
    grouped = dates.groupBy("horizon").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("target", "d"))), lambda s: s["d"]).alias("ds"), F.avg("d").alias("mean"), F.count("*").alias("dates"))
    centred = grouped.withColumn("c", F.transform("ds", lambda x: x - F.col("mean")))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    auto = lambda k: total(F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - k, F.lit(0))), F.slice("c", k + 1, F.size("c")), lambda a, b: a * b)) / F.col("dates")
    gamma0 = total(F.transform("c", lambda x: x * x)) / F.col("dates")
    lags = F.when(F.col("horizon") > 1, F.sequence(F.lit(1), F.col("horizon") - 1)).otherwise(F.array().cast("array<int>"))
    lrv = gamma0 + total(F.transform(lags, lambda k: 2 * (1 - k / F.col("horizon")) * auto(k)))
    h, n = F.col("horizon"), F.col("dates")
    out = centred.withColumn("lrv", lrv).withColumn("corr2", (n + 1 - 2 * h + h * (h - 1) / n) / n)
    enough = n >= F.greatest(F.lit(8), 2 * h + 1)
    valid = enough & (F.col("lrv") > 0) & (F.col("corr2") > 0)
    se = F.sqrt(F.col("lrv") / n) / F.sqrt("corr2")
    out = out.withColumn("statistic", F.when(valid, F.col("mean") / se))
    status = F.when(valid, "reported").when(n < 2, "single_date").when(~enough, "too_few_dates").otherwise("degenerate_variance")
    return out.select("horizon", "dates", F.col("mean").alias("mean_difference"), "statistic",
                      F.when(valid, scalars.student_two_sided_p("statistic", n - 1)).alias("p_value"), status.alias("status"))


def holm(tests: DataFrame, p: str, family: list[str] | None = None) -> DataFrame:
    """Step-down adjusted p-values inside a family of tests; NULLs stay NULL and do not count."""
    family = family or []
    by = W.partitionBy(F.col(p).isNotNull(), *family) if family else W.partitionBy(F.col(p).isNotNull())
    rank = F.row_number().over(by.orderBy(p))
    size = F.count(p).over(by)
    stepped = tests.withColumn("_s", F.col(p) * (size - rank + 1)).withColumn("_r", rank)
    run = by.orderBy("_r").rowsBetween(W.unboundedPreceding, W.currentRow)
    return stepped.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_s").over(run)))).drop("_s", "_r")
