"""Mixing sources to target weights by entropy balancing.

The rates of documents, between 0 and ``most``, deviate as little as possible from 1 in the sense of bounded entropy while the tokens of every
source meet its target. The dual of that problem is convex with one multiplier λ per source, and gives exponentially tilted rates:
``rate / (most - rate) = exp(λ size / mean size) / (most - 1)``. Newton steps on the dual, all sources in one job, find the multipliers.

Documents of equal size in a source have equal rates, so the steps read a table of (source, size, count). The tilt of a step is summed in
whole numbers, which makes reruns agree on any cluster. Rates then become copies by a fold along the sizes of a source, largest first: the
documents of a size take as many copies, up to ``most`` each, as their rates and the words still owed ask for. What the rounding of one size
leaves over the smaller ones make up, so a source misses its target by about half of a small document.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepanel.llm.common import store, table

WEIGHTS, MOST = (1, 2, 3), 3
#: Newton steps at most, and the share of its target (and a thousandth word) by which a source may miss it when they end.
STEPS, CLOSE = 60, 1e-7
#: Parts to which the documents of one source and size are dealt to be numbered; fixed-point unit of summed tokens.
_PARTS, _UNIT = 256, float(1 << 20)
WHOLE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _places(sources: DataFrame) -> DataFrame:
    """Adds ``place``: number of the source by code point, null last; sorted in ranges, so there may be any number of them."""
    by = F.col("source").asc_nulls_last()
    ranges = store(sources.repartitionByRange(by).withColumn("part", F.spark_partition_id()), "sources")
    before = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranges.join(before, "part").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1).drop("part", "before")


def _targets(sources: DataFrame, weights: tuple, most: int) -> DataFrame:
    """Adds ``target`` and ``full``: whether the target stands at ``most`` times the size."""
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = store(sources.withColumn("weight", weight), "weights")
    size, w = F.col("source_size").cast(WHOLE), F.col("weight").cast(WHOLE)
    total, shared = sources.agg(F.sum(size), F.sum(w)).first()
    total, held, free, last = int(total or 0), 0, int(shared or 0), None
    full = F.lit(False)
    while (held, free) != last:  # each round holds sources at their limit and reshares the rest: two numbers reach the driver
        last = held, free
        full = (most * size * F.lit(free).cast(WHOLE) <= w * F.lit(total - held).cast(WHOLE)) if free else F.lit(True)
        found = sources.agg(F.sum(F.when(full, most * size)), F.sum(F.when(~full, w))).first()
        held, free = int(found[0] or 0), int(found[1] or 0)
    share = (w * F.lit(total - held).cast(WHOLE)).cast("double") / F.lit(float(free or 1))
    return sources.withColumn("full", full).withColumn("target", F.when(F.col("full"), (most * size).cast("double")).otherwise(share))


def _rate(most: int) -> Column:
    """Rate of a cell under ``lam``; exactly ``most`` in full sources and 1 for documents without words."""
    tilted = most / (1 + (most - 1) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -F.col("lam") * F.col("size") / F.col("mean")))))
    return F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(most)).otherwise(tilted)


def _multipliers(cells: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(place, lam): Newton steps on the logarithm of the tokens taken (or, above the size, of those left), kept inside a bracket."""
    none = F.lit(None).cast("double")
    state = store(sources.select("place", "full", "target", "source_size", F.lit(0.0).alias("lam"), none.alias("lo"), none.alias("hi"),
                                 (F.col("full") | (F.col("source_size") == 0)).alias("done")), "multipliers")
    cells = cells.where("not full and size > 0").select("place", "size", "k", "mean", "full")
    for _ in range(STEPS):
        if not state.where("not done").limit(1).count():
            break
        rate, words = _rate(most), F.col("k") * F.col("size").cast("double")
        exact = lambda c: F.sum(F.round(c * _UNIT).cast(WHOLE)).cast("double") / _UNIT
        sums = cells.join(state.where("not done").select("place", "lam"), "place").groupBy("place").agg(
            exact(words * rate).alias("f"), exact(words * rate * (1 - rate / most) * F.col("size") / F.col("mean")).alias("df"))
        lam, f, target, whole = F.col("lam"), F.col("f"), F.col("target"), most * F.col("source_size").cast("double")
        near = F.abs(f - target) <= CLOSE * target + 1e-3
        lo, hi = F.when(f < target, lam).otherwise(F.col("lo")), F.when(f > target, lam).otherwise(F.col("hi"))
        tiny = F.lit(1e-300)
        step = F.when(target <= F.col("source_size"), F.log(F.greatest(target, tiny) / F.greatest(f, tiny)) * f / F.col("df")).otherwise(
            F.log((whole - f) / F.greatest(whole - target, tiny)) * (whole - f) / F.col("df"))
        wide = F.when(lo.isNull(), hi - 1 - F.abs(hi)).when(hi.isNull(), lo + 1 + F.abs(lo)).otherwise((lo + hi) / 2)
        moved = lam + F.when(F.col("df") > 0, step)
        inside = moved.isNotNull() & ~F.isnan(moved) & (F.coalesce(moved > lo, F.lit(True)) & F.coalesce(moved < hi, F.lit(True)))
        narrow = F.coalesce(hi - lo <= 1e-15 * F.greatest(F.abs(lo), F.abs(hi)), F.lit(False))
        after = state.join(sums, "place", "left")
        state = store(after.select(
            "place", "full", "target", "source_size", F.when(F.col("done") | near, lam).when(inside & (F.abs(moved - lam) < 1e3), moved).otherwise(wide).alias("lam"),
            lo.alias("lo"), hi.alias("hi"), (F.col("done") | near | narrow).alias("done")), "multipliers")
    return state.select("place", "lam")


def _fold(cells: pd.DataFrame, most: int) -> pd.DataFrame:
    """Copies of each document of a size, and how many of them take one more; rows are the sizes of one source, not its documents."""
    cells = cells.sort_values("size", ascending=False)
    owed, taken = 0.0, []
    for size, k, rate in zip(cells["size"].tolist(), cells["k"].tolist(), cells["rate"].tolist()):
        owed += k * size * rate
        taken.append(min(most * k, max(0, round(owed / size))) if size else k)
        owed -= taken[-1] * size
    taken = np.array(taken, np.int64)
    return cells.assign(copies=taken // cells["k"], more=taken % cells["k"])[["place", "source", "size", "source_size", "target", "rate", "copies", "more"]]


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each row of ``docs``: key, source, size, source_size, target, rate, copies, taken.

    ``weights`` go round over the sources, sorted by code point with null last, which is a source like any other. Targets share the
    tokens of all sources by weight; one above ``most`` times its source is held there and the excess reshared. Documents without words
    have rate and copies 1 and take nothing; a null text has none. Equal rows are separate documents. The key may be null or repeat, other
    columns are ignored, and an empty table gives no rows.
    """
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), (F.spark_partition_id() % 1024).alias("salt"))
    groups = store(sized.groupBy("source", "size", "key", "salt").agg(F.count(F.lit(1)).alias("m")), "sizes")  # a key with many rows stays spread
    hist = store(groups.groupBy("source", "size").agg(F.sum("m").alias("k")), "histogram")
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("k")).alias("source_size"), F.sum("k").alias("docs"))
    sources = store(_targets(_places(sources), weights, most), "targets")
    cells = store(hist.join(sources, hist["source"].eqNullSafe(sources["source"])).select(
        hist["source"].alias("source"), "place", "size", "k", "source_size", "target", "full",
        F.greatest(F.lit(1e-300), F.col("source_size") / F.col("docs")).alias("mean")), "cells")
    rated = cells.join(_multipliers(cells, sources, most), "place").withColumn("rate", _rate(most))
    rated = store(rated.groupBy("place").applyInPandas(lambda cells: _fold(cells, most), "place long, source string, size long, source_size long, target double, rate double, copies long, more long"), "rates")
    dealt = F.xxhash64("key")
    groups = groups.withColumns({"hash": dealt, "part": F.pmod(dealt, F.lit(_PARTS)).cast("int")})
    parts = groups.groupBy("source", "size", "part").agg(F.sum("m").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.join(rated, parts["source"].eqNullSafe(rated["source"]) & (parts["size"] == rated["size"])).select(
        rated["place"], parts["source"].alias("s"), parts["size"].alias("z"), F.col("part").alias("p"), "before", "source_size", "target", "rate", "copies", "more")
    inside = Window.partitionBy("source", "size", "part").orderBy("hash", "key", "salt").rowsBetween(Window.unboundedPreceding, -1)
    numbered = groups.withColumn("within", F.coalesce(F.sum("m").over(inside), F.lit(0)))
    joined = numbered.join(parts, numbered["source"].eqNullSafe(parts["s"]) & (numbered["size"] == parts["z"]) & (numbered["part"] == parts["p"]))
    joined = joined.withColumn("extra", F.greatest(F.lit(0), F.least("m", F.col("more") - F.col("before") - F.col("within"))))
    rows = joined.withColumn("j", F.explode(F.sequence(F.lit(1), "m"))).withColumn("copies", F.col("copies") + (F.col("j") <= F.col("extra")).cast("long"))
    return rows.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long"), "target", F.col("taken").cast("long"), "rate", F.col("copies").cast("long"))
