"""Recursions without a SQL form against brute force on small inputs."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import detectors, intervals, trend
from tidepanel.schema import DetectorSettings


def _segment_logp(xs, s, sigma):
    """Marginal likelihood of a segment under the Normal–inverse-Gamma prior, one value at a time."""
    mu, k, a, b, total = s.bocpd_mu, s.bocpd_kappa, s.bocpd_alpha, sigma**2, 0.0
    for x in xs:
        scale2, dof = b * (k + 1) / (a * k), 2 * a
        total += math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi * scale2) - (dof + 1) / 2 * math.log1p((x - mu) ** 2 / (dof * scale2))
        b += 0.5 * k / (k + 1) * (x - mu) ** 2
        mu, k, a = (k * mu + x) / (k + 1), k + 1, a + 0.5
    return total


def _enumerated(xs, s, sigma):
    """P(boundary before the last value) by summing over all partitions of the prefix."""
    weights = {True: 0.0, False: 0.0}
    n = len(xs)
    for cuts in itertools.product([False, True], repeat=n - 1):
        bounds = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
        logp = sum(_segment_logp(xs[a:b], s, sigma) for a, b in zip(bounds, bounds[1:]))
        logp += sum(math.log(s.bocpd_hazard if c else 1 - s.bocpd_hazard) for c in cuts)
        weights[bool(cuts[-1])] += math.exp(logp)
    return weights[True] / (weights[True] + weights[False])


def test_bocpd_equals_enumeration(spark):
    s, sigma, xs = DetectorSettings(), 0.15, [0.1, -0.1, 0.8, 0.9]
    got = detectors.bocpd_matrix(np.array([xs]), np.array([sigma]), s)[0]
    assert np.isnan(got[0])
    for t in range(1, 4):
        assert got[t] == pytest.approx(_enumerated(xs[: t + 1], s, sigma), rel=1e-9)
    gap = detectors.bocpd_matrix(np.array([[0, 0, np.nan, 1, 1.1]]), np.array([0.2]), s)[0]
    assert [bool(np.isnan(v)) for v in gap] == [True, False, True, True, False]
    signal = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)] + [(2, 0, 0.0), (2, 1, 0.0)], "id long, m int, z double")
    rows = detectors.score_bocpd(signal, ["id"], spark.createDataFrame([(sigma,)], "sigma double")).filter("id = 1").orderBy("m").collect()
    assert [r["score"] for r in rows][1:] == pytest.approx(list(got[1:]))


@pytest.mark.parametrize("cost", ["l2", "rbf"])
def test_offline_segmentation_is_exact(cost):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.3, 5), rng.normal(3, 0.3, 5)])

    def total(bounds):
        value = 2.0 * (len(bounds) - 2)
        for a, b in zip(bounds, bounds[1:]):
            part = x[a:b]
            value += ((part - part.mean()) ** 2).sum() if cost == "l2" else len(part) - np.exp(-((part[:, None] - part[None]) ** 2)).sum() / len(part)
        return value

    options = []
    for k in range(4):
        for cut in itertools.combinations(range(2, 9), k):
            bounds = [0, *cut, 10]
            if all(b - a >= 2 for a, b in zip(bounds, bounds[1:])):
                options.append((total(bounds), list(cut)))
    assert detectors.segment_boundaries(x, 2.0, cost) == min(options)[1]
    assert detectors.segment_boundaries(np.repeat([0.0, 10.0], 12), 2.0) == [12]


def test_matching(spark):
    """Most pairs, then least distance, against every assignment."""
    rng = np.random.default_rng(1)
    cases = [([5, 7], [6, 8]), ([5], [4, 5, 6]), ([5], [7]), ([], [1]), ([3], [])]
    cases += [tuple(sorted(set(rng.integers(0, 9, rng.integers(0, 5)).tolist())) for _ in range(2)) for _ in range(150)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "id long, truth array<int>, found array<int>")
    got = {r["id"]: [(p["truth"], p["found"]) for p in r["matches"]] for r in detectors.match_events(df, ["id"]).collect()}
    assert got[0] == [(5, 6), (7, 8)] and got[1] == [(5, 5)] and got[2] == []
    for i, (a, b) in enumerate(cases):
        best = (0, 0)
        for r in range(min(len(a), len(b)) + 1):
            for left in itertools.combinations(a, r):
                for right in itertools.permutations(b, r):
                    gaps = [abs(x - y) for x, y in zip(left, right)]
                    if all(g <= 1 for g in gaps):
                        best = min(best, (-r, sum(gaps)))
        assert (-len(got[i]), sum(abs(x - y) for x, y in got[i])) == best
        assert all(x in a and y in b for x, y in got[i])


@pytest.mark.parametrize("cost", ["l2", "rbf"])
def test_pruning_and_penalty_paths_lose_nothing(spark, cost):
    """Against a table of the best cost by number of boundaries, for every penalty."""
    rng = np.random.default_rng(7)
    frames, low, high = [], 0.3, 40.0
    for i in range(25):
        n = int(rng.integers(1, 26))
        x = np.cumsum(rng.normal(0, 1, n) * (rng.random(n) < 0.3)) + rng.normal(0, 0.4, n)
        frames += [(i, int(m), float(v)) for m, v in enumerate(x)]
        segment = detectors.segment_cost(x, cost)
        table = {0: {0: (0.0, [])}}  # end -> boundaries so far -> (cost, boundaries)
        for j in range(1, n + 1):
            table[j] = {}
            for a in range(j - 1 if j > 1 else j):
                if a == 0 and (j >= 2 or n < 2) or a >= 2 and j - a >= 2:
                    for k, (c, way) in table[a].items():
                        new = (c + float(segment(np.array([a]), j)[0]), way + [a] * (a > 0))
                        table[j][k + (a > 0)] = min(table[j].get(k + (a > 0), new), new)
        paths = detectors.segment_path(x, low, high, cost)
        assert paths[0][0] == low and paths[-1][1] == high and all(p[1] == q[0] for p, q in zip(paths, paths[1:]))
        for penalty in [low, *rng.uniform(low, high, 30), high]:
            if n >= 4:
                want = min(c + penalty * k for k, (c, _) in table[n].items())
                bounds, total = detectors.best_segments(segment, n, penalty)
                assert total + penalty * len(bounds) == pytest.approx(want, abs=1e-7)
                own = next(p for p in paths if p[0] <= penalty <= p[1])
                assert own[3] + penalty * len(own[2]) == pytest.approx(want, abs=1e-7)
    signal = spark.createDataFrame(frames, "id long, m int, z double")
    sigma = spark.createDataFrame([(1.0,)], "sigma double")
    found = detectors.offline_changepoints(signal, ["id"], [0.5, 3.0, 40.0], sigma, cost)
    got = {(r["id"], r["penalty"], r["m"]) for r in found.collect()}
    series = {i: np.array([v for j, _, v in frames if j == i]) for i in range(25)}
    assert got == {(i, p, b) for i, x in series.items() for p in (0.5, 3.0, 40.0) for b in detectors.segment_boundaries(x, p, cost)}
    counts = lambda p: sum(len(detectors.segment_boundaries(x, p, cost)) for x in series.values())
    months = spark.createDataFrame([(len(frames),)], "months long")
    budget = 100 * counts(3.0) / len(frames)
    least = detectors.least_penalty(detectors.segmentations(signal, ["id"], 0.3, 40.0, sigma, cost), months, budget).first()
    assert counts(least["penalty"] + 1e-5) <= counts(3.0) < counts(max(0.3, least["penalty"] - 1e-5)) and least["penalty"] <= 3.0 and least["per100"] <= budget


def test_onset_counts(spark):
    df = spark.createDataFrame([(1, [4, 8], [1, 4, 8]), (2, [4, 8], [8]), (3, [], [2])], "id long, truth array<int>, found array<int>")
    got = {r["id"]: (r["onset_tp"], r["onset_fp"], r["onset_fn"]) for r in detectors.match_events(df, ["id"]).collect()}
    assert got == {1: (1, 1, 0), 2: (0, 0, 1), 3: (0, 1, 0)}
    scored = detectors.event_scores(detectors.match_events(df, ["id"]).withColumn("split", F.lit("selection")).withColumn("method", F.lit("x")).withColumn(
        "shape", F.when(F.col("id") == 3, "no_change").otherwise("step")), ["split", "method"], 10).filter("shape = 'all'").first()
    assert (scored["onset_tp"], scored["onset_fp"], scored["onset_fn"]) == (1, 2, 1) and scored["null_per100"] == 10.0


def test_adaptive_intervals(spark):
    """Feedback moves α after a month only; the whole path equals a plain loop."""
    rng = np.random.default_rng(2)
    ids, months = range(1, 17), range(8)
    rows = [(i, m, 100.0 * i + float(rng.normal(0, i)), 100.0 * i, 100.0 * i) for i in ids for m in months]
    fc = spark.createDataFrame(rows, "id long, target int, actual double, predicted double, mean_value double")
    out = {(r["id"], r["target"]): r for r in intervals.calibrate_adaptive(fc, [3, 4, 5, 6, 7], 0.8, 0.1).collect()}
    alpha = 1 - 0.8
    err = {(i, m): abs(a - p) / s for i, m, a, p, s in rows}
    for t in (3, 4, 5, 6, 7):
        scores = sorted(err[i, m] for i in ids for m in (t - 3, t - 2, t - 1))
        rank = math.ceil((len(scores) + 1) * (1 - alpha))
        q = scores[rank - 1] if rank <= len(scores) else math.inf
        assert out[1, t]["alpha"] == pytest.approx(alpha) and out[1, t]["q"] == pytest.approx(q)
        miss = np.mean([err[i, t] > q for i in ids])
        alpha = min(max(alpha + 0.1 * ((1 - 0.8) - miss), 0.005), 0.5)


def test_fourier_ridge_recovers_a_line(spark):
    rows = [(1, m, 50.0 + 2.0 * m) for m in range(36)]
    out = trend.fourier_ridge(spark.createDataFrame(rows, "id long, m int, value double"), 0, [1, 6]).filter("origin = 30").collect()
    assert {r["horizon"]: r["predicted"] for r in out} == pytest.approx({1: 112.0, 6: 122.0}, rel=1e-6)
