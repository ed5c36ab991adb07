"""Distributed order statistics against sorting, on groups above and below the whole-group size."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import accuracy, intervals, joins
from tidepanel.operators import quantiles as q


@pytest.fixture(scope="module")
def skewed(spark):
    """One hot group of 60 000 rows with a third of them tied, and small groups of every size 1…9."""
    rng = np.random.default_rng(5)
    hot = np.where(rng.random(60_000) < 0.34, 2.5, rng.lognormal(1, 2, 60_000))
    rows = [("hot", i, float(v)) for i, v in enumerate(hot)]
    rows += [(f"g{n}", i, float(v)) for n in range(1, 10) for i, v in enumerate(rng.integers(0, 4, n))]
    df = spark.createDataFrame(rows, "g string, id long, v double").repartition(8)
    by = {}
    for g, _, v in rows:
        by.setdefault(g, []).append(v)
    return df.cache(), by


def test_quantiles_are_exact(skewed):
    df, by = skewed
    for p in (0.0, 0.05, 0.5, 0.9, 0.99, 1.0):
        got = {r["g"]: r["x"] for r in q.grouped_quantile(df, ["g"], "v", {"x": p}).collect()}
        for g, values in by.items():
            assert got[g] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_finite_quantile_rank_and_overflow(skewed):
    df, by = skewed
    got = {r["g"]: (r["a"], r["b"]) for r in intervals.finite_quantile(df, ["g"], "v", 0.9, "a").join(
        intervals.finite_quantile(df, ["g"], "v", 0.9, "b", clamp=True).drop("n"), "g").collect()}
    for g, values in by.items():
        rank, s = math.ceil((len(values) + 1) * 0.9), sorted(values)
        assert got[g][0] == (math.inf if rank > len(s) else s[rank - 1])
        assert got[g][1] == s[min(rank, len(s)) - 1]


def test_leave_one_out_median(spark, skewed):
    df, by = skewed
    small = df.filter("g <> 'hot'")
    out = joins.leave_one_out_median(small, ["g"], "v", 1).collect()
    for r in out:
        rest = list(by[r["g"]])
        rest.remove(r["v"])
        assert r["peers"] == len(rest)
        assert (r["peer_median"] is None and not rest) or r["peer_median"] == pytest.approx(np.median(rest))
    # The hot group: removing one of many members leaves one of the middle values.
    hot = joins.leave_one_out_median(df.filter("g = 'hot'"), ["g"], "v", 1)
    lo, hi = hot.agg(F.min("peer_median"), F.max("peer_median")).first()
    values = sorted(by["hot"])
    assert values[len(values) // 2 - 1] <= lo <= hi <= values[len(values) // 2]


def test_missing_own_value_keeps_all_peers(spark):
    df = spark.createDataFrame([(1, 56, 100.0), (2, 56, 1.0), (3, 56, 2.0), (4, 56, 3.0), (5, 56, 4.0), (6, 56, 5.0), (7, 57, 999.0), (8, 56, None), (9, None, 4.0)], "id long, region long, own double")
    got = {r["id"]: (r["peers"], r["peer_median"]) for r in joins.leave_one_out_median(df, ["region"], "own", 5).collect()}
    assert got[1] == (5, 3.0)
    assert got[8] == (6, 3.5)
    assert got[7] == (0, None) and got[9][1] is None


def test_top_share_and_drop_largest(skewed):
    df, by = skewed
    got = {r["g"]: r["x"] for r in q.top_share(df, ["g"], "v", 0.05, "x").collect()}
    for g, values in by.items():
        k = math.ceil(0.05 * len(values))
        total = sum(values)
        assert got[g] == pytest.approx(sum(sorted(values)[-k:]) / total if total else 0.0)
    hot = df.filter("g = 'hot'")
    kept = q.drop_largest(hot, [], "v", "id", 0.7)
    order = sorted(((-r["v"], r["id"]) for r in hot.collect()))
    want = {i for _, i in order[math.ceil(0.7 * len(order)):]}
    assert {r["id"] for r in kept.select("id").collect()} == want


def test_weighted_median(spark, skewed):
    df, by = skewed
    got = {r["g"]: r["x"] for r in q.weighted_median(df.withColumn("w", F.lit(1.0) + F.col("id") % 3), ["g"], "v", "w", "x").collect()}
    for g, values in by.items():
        pairs = sorted((v, 1.0 + i % 3) for i, v in enumerate(values))
        half, total = sum(w for _, w in pairs) / 2, 0.0
        for v, w in pairs:
            total += w
            if total >= half:
                assert got[g] == v
                break


def test_ranks_by_ranges(skewed):
    df, by = skewed
    for r in accuracy.ranges_rank(df, ["g"], "v", "k").filter("g <> 'hot' or id < 50").collect():
        assert r["k"] == 1 + sum(v > r["v"] for v in by[r["g"]])
