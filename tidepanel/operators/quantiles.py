"""Exact order statistics that never bring a whole group to one task.

A quantile sketch brackets the wanted ranks (map-side combined, bounded size). Rows outside the
brackets collapse to counts, rows inside collapse to value → count, and the exact value is read from
the cumulative count. A group of any size therefore costs two scans of its rows plus a window over
the few values inside its brackets; small groups are bracketed whole, so the result is exact always.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepanel.session import cut_lineage

SKETCH_ACCURACY = 10_000
# Below this count a group is kept whole. Above it the bracket of ±4/accuracy holds every rank within
# four rows of the wanted one, because the sketch is off by at most n/accuracy rows.
WHOLE_GROUP = 20_000
BRACKET = 4.0 / SKETCH_ACCURACY

Rank = tuple[float, Callable[[Column], Column]]


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their group, which exists for every row; rows with a NULL key go.

    As an outer join only the side of the groups can be broadcast. Repeated values make a stored table so small that the optimizer would
    else broadcast its rows.
    """
    return rows.filter(reduce(and_, [F.col(k).isNotNull() for k in keys])).join(groups, keys, "left")


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """keys + group size ``n`` + one column per rank.

    ``ranks`` maps a name to (share, rank(n)): the 1-based rank must stay within three rows of
    share·n. Ranks outside 1…n give NULL.
    """
    grain = keys or ["_all"]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    if not keys:
        rows = rows.withColumn("_all", F.lit(1))
    rows = cut_lineage(rows, "values")  # read twice below; what leads to it runs once, also when order statistics are nested
    probs = sorted({p for p, _ in ranks.values()})
    edges = [min(1.0, max(0.0, p + s)) for p in probs for s in (-BRACKET, BRACKET)]
    sketch = rows.groupBy(*grain).agg(
        F.count("*").alias("n"),
        F.expr(f"approx_percentile(_v, array({','.join(repr(e) for e in edges)}), {SKETCH_ACCURACY})").alias("_cut"),
    )
    # One row in the ungrouped case: a proven bound, so it is broadcast. Grouped sketches are left to
    # the size check of the optimizer and of AQE.
    if keys:
        joined = with_group(rows, sketch, keys)
    else:
        joined = rows.drop("_all").crossJoin(F.broadcast(sketch))
    inside = F.col("n") <= WHOLE_GROUP
    slot = F.lit(0)
    for i in range(len(probs)):
        low, high = F.col("_cut")[2 * i], F.col("_cut")[2 * i + 1]
        inside = inside | F.col("_v").between(low, high)
        slot = slot + (F.col("_v") > high).cast("int")
    reduced = (
        joined.withColumn("_in", F.when(inside, F.col("_v")))
        .withColumn("_slot", F.when(F.col("_in").isNull(), slot))
        .groupBy(*grain, "n", "_in", "_slot")
        .agg(F.count("*").alias("_c"), F.max("_v").alias("_ord"))
    )
    ordered = W.partitionBy(*grain).orderBy("_ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    cumulative = reduced.withColumn("_cum", F.sum("_c").over(ordered))
    picks = []
    for name, (_, rank) in ranks.items():
        r = rank(F.col("n"))
        hit = (F.col("_cum") >= r) & (F.col("_cum") - F.col("_c") < r)
        # A rank outside its bracket would stand for a collapsed slot, not for a value.
        found = F.when(F.col("_in").isNull(), F.raise_error(F.lit(f"rank of {name} is outside its bracket")).cast("double")).otherwise(F.col("_ord"))
        picks.append(F.max(F.when(hit, found)).alias(name))
    out = cumulative.groupBy(*grain, "n").agg(*picks)
    return out if keys else out.drop("_all")


def grouped_quantile(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group, exact for groups of any size."""
    ranks: dict[str, Rank] = {}
    for name, p in probs.items():
        ranks[f"_lo_{name}"] = (p, lambda n, p=p: F.floor((n - 1) * p) + 1)
        ranks[f"_hi_{name}"] = (p, lambda n, p=p: F.ceil((n - 1) * p) + 1)
    stats = order_statistics(df, keys, value, ranks)
    picked = []
    for name, p in probs.items():
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        share = (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
        picked.append((low + (high - low) * share).alias(name))
    return stats.select(*keys, "n", *picked)


def grouped_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return grouped_quantile(df, keys, value, {name: 0.5})


def bounded_median(value) -> Column:
    """Median aggregate for groups bounded by the month axis (one id, a few periods)."""
    return F.percentile(value, 0.5)


def peer_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Middle order statistics per group, enough to remove any single member exactly."""
    h = lambda n: F.ceil(n / 2)
    return order_statistics(
        df, keys, value,
        {"_below": (0.5, lambda n: h(n) - 1), "_mid": (0.5, h), "_above": (0.5, lambda n: h(n) + 1)},
    ).withColumnRenamed("n", "_n")


def without_own(own) -> Column:
    """Median of the group without one member whose value is ``own`` (NULL: nothing to remove).

    Removing a member shifts the ranks above it by one. A member tied with the middle value gives the
    same answer whichever tied row is removed, so comparing values is enough.
    """
    own = F.col(own) if isinstance(own, str) else own
    n, below, mid, above = (F.col(c) for c in ("_n", "_below", "_mid", "_above"))
    even = n % 2 == 0
    whole = F.when(even, (mid + above) / 2).otherwise(mid)
    after = F.when(even, F.when(own > mid, mid).otherwise(above)).otherwise(
        (F.when(own > below, below).otherwise(mid) + F.when(own > mid, mid).otherwise(above)) / 2
    )
    return F.when(own.isNull(), whole).otherwise(after)


def top_share(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """Share of the total held by the ⌈share·n⌉ largest values of each group.

    The k-th largest value t is an order statistic, and the top sum is Σ(v > t) + t·(k − #(v > t)).
    """
    k = lambda n: F.ceil(n * share)
    cut = order_statistics(df, keys, value, {"_t": (1 - share, lambda n: n - k(n) + 1)})
    joined = df.join(cut, on=keys) if keys else df.crossJoin(F.broadcast(cut))
    above = F.col(value) > F.col("_t")
    agg = joined.groupBy(*keys, "n", "_t").agg(
        F.sum(F.when(above, F.col(value)).otherwise(0.0)).alias("_s"),
        F.count(F.when(above, 1)).alias("_k"),
        F.sum(value).alias("_total"),
    )
    top = F.col("_s") + F.col("_t") * (k(F.col("n")) - F.col("_k"))
    return agg.select(
        *keys, k(F.col("n")).alias(f"{name}_n"),
        F.when(F.col("_total") > 0, top / F.col("_total")).otherwise(0.0).alias(name),
    )


def drop_largest(df: DataFrame, keys: list[str], value: str, tie: str, share: float) -> DataFrame:
    """Rows left after removing the ⌈share·n⌉ largest, ties removed by the smallest ``tie`` first."""
    df = cut_lineage(df, "ranked")
    k = lambda n: F.ceil(n * share)
    cut = order_statistics(df, keys, value, {"_t": (1 - share, lambda n: n - k(n) + 1)})
    attach = lambda left, right: left.join(right, on=keys) if keys else left.crossJoin(F.broadcast(right))
    marked = attach(df, cut)
    need = marked.groupBy(*keys, "n").agg(F.count(F.when(F.col(value) > F.col("_t"), 1)).alias("_k"))
    need = need.select(*keys, (k(F.col("n")) - F.col("_k")).alias("_need"))
    tied = attach(marked.filter(F.col(value) == F.col("_t")).drop("n"), need)
    # The tie column is an id, so the need-th smallest id among the ties is again a rank search. Its
    # share is unknown in advance; counting distinct ids in buckets keeps it exact for any tie size.
    last = _smallest_ids(tied, keys, tie)
    out = attach(marked.drop("n"), last)
    return out.filter(
        (F.col(value) < F.col("_t")) | ((F.col(value) == F.col("_t")) & (F.col(tie) > F.col("_last")))
    ).drop("_t", "_last")


def _smallest_ids(tied: DataFrame, keys: list[str], tie: str, buckets: int = 4096) -> DataFrame:
    """Per group the ``_need``-th smallest id, by a bucket count first and the one bucket after."""
    grain = keys or ["_all"]
    base = tied.select(*keys, tie, "_need")
    if not keys:
        base = base.withColumn("_all", F.lit(1))
    span = base.groupBy(*grain).agg(F.min(tie).alias("_a"), F.max(tie).alias("_b"))
    width = F.greatest(F.ceil((F.col("_b") - F.col("_a") + 1) / buckets), F.lit(1))
    placed = (base.join(span, on=keys) if keys else base.crossJoin(F.broadcast(span.drop("_all")))).withColumn("_bucket", F.floor((F.col(tie) - F.col("_a")) / width))
    run = W.partitionBy(*grain).orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    chosen = (
        placed.groupBy(*grain, "_need", "_bucket").agg(F.count("*").alias("_c"))
        .withColumn("_cum", F.sum("_c").over(run))
        .filter((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_c") < F.col("_need")))
        .select(*grain, "_bucket", (F.col("_need") - F.col("_cum") + F.col("_c")).alias("_rank"))
    )
    order = W.partitionBy(*grain).orderBy(tie)
    out = (
        placed.join(chosen, on=[*grain, "_bucket"])
        .withColumn("_r", F.row_number().over(order))
        .filter("_r = _rank")
        .select(*keys, F.col(tie).alias("_last"))
    )
    return out


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """First value, in order, whose cumulative weight reaches half of the total.

    Equal values are merged first. A large group is split at approximate cut points, only the bucket
    that holds the half enters an ordered window, and the weights below it enter as one sum. Small
    groups are one bucket. The merged rows are written once, because three passes read them.
    """
    grain = keys or ["_all"]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w"))
    if not keys:
        rows = rows.withColumn("_all", F.lit(1))
    rows = cut_lineage(rows.groupBy(*grain, "_v").agg(F.sum("_w").alias("_w")), "weights")
    probs = ",".join(repr(i / 256) for i in range(1, 256))
    sketch = rows.groupBy(*grain).agg(
        F.count("*").alias("_n"), (F.sum("_w") / 2).alias("_half"),
        F.expr(f"approx_percentile(_v, array({probs}), 2000)").alias("_cuts"))
    small = F.col("_n") <= WHOLE_GROUP
    placed = with_group(rows, sketch, grain).withColumn(
        "_bucket", F.when(small, F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_v")))))
    run = W.partitionBy(*grain).orderBy("_bucket")
    chosen = (
        placed.groupBy(*grain, "_bucket", "_half").agg(F.sum("_w").alias("_bw"))
        .withColumn("_cum", F.sum("_bw").over(run.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("_base", F.coalesce(F.lag("_cum").over(run), F.lit(0.0)))
        .filter(F.col("_cum") >= F.col("_half"))
        .groupBy(*grain).agg(F.min("_bucket").alias("_bucket"), F.min_by("_base", "_bucket").alias("_base")))
    order = W.partitionBy(*grain).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = placed.select(*grain, "_bucket", "_v", "_w", "_half").join(chosen, on=[*grain, "_bucket"])
    out = (
        inside.withColumn("_cum", F.sum("_w").over(order) + F.col("_base"))
        .filter(F.col("_cum") >= F.col("_half"))
        .groupBy(*grain).agg(F.min("_v").alias(name)))
    return out if keys else out.drop("_all")
