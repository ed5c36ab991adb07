"""Bootstrap over ids: weights are draws with replacement, and arrays over draws give what rows would."""
import numpy as np
import pytest

from tidepanel.operators import inference


def test_weights_are_draws_with_replacement():
    sizes, draws = np.array([5, 0, 1, 34]), 4000
    w = np.array([x for b in range(4) for x in inference.unit_weights(sizes, b, draws, 3)])
    assert w.shape == (40, draws) and (w.sum(axis=0) == 40).all() and w.min() >= 0
    assert np.allclose(w.mean(axis=1), 1, atol=0.09) and np.allclose(w.var(axis=1), 1 - 1 / 40, atol=0.12)
    both = np.corrcoef(w)[np.triu_indices(40, 1)]
    assert abs(both.mean() + 1 / 39) < 0.005 and np.abs(both + 1 / 39).max() < 0.08  # picks compete for the same total
    again = np.array([x for b in range(4) for x in inference.unit_weights(sizes, b, draws, 3)])
    assert (w == again).all()


def test_intervals_equal_those_of_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(h, i, t, float(rng.gamma(2, 10 + i % 5)), float(rng.gamma(2, 8 + i % 7))) for h in (1, 3) for i in range(300) for t in range(6) if (i + t + h) % 4]
    frame = spark.createDataFrame(rows, "horizon int, id long, target int, loss_a double, loss_b double").repartition(5)
    got = {r["horizon"]: r for r in inference.bootstrap_units(frame, 800, 11).collect()}
    bucket = {r["id"]: r["b"] for r in frame.selectExpr("id", f"cast(pmod(xxhash64(id), {inference._BUCKETS}) as int) b").distinct().collect()}
    sizes = np.bincount(list(bucket.values()), minlength=inference._BUCKETS)
    weight = {}
    for b in sorted(set(bucket.values())):
        weight |= dict(zip(sorted(i for i, x in bucket.items() if x == b), inference.unit_weights(sizes, b, 800, 11)))
    for h in (1, 3):
        sums = np.zeros((3, 6, 800))
        for k, i, t, a, b in rows:
            if k == h:
                sums[:, t] += np.array([a, b, 1.0])[:, None] * weight[i]
        a, b = (sums[k] / sums[2] for k in (0, 1))
        diff, red = b.mean(axis=0) - a.mean(axis=0), 100 * (1 - b.mean(axis=0) / a.mean(axis=0))
        want = [*np.quantile(diff, [0.025, 0.975]), *np.quantile(red, [0.025, 0.975])]
        assert [got[h][c] for c in ("difference_low", "difference_high", "reduction_low", "reduction_high")] == pytest.approx(want, rel=1e-9) and got[h]["draws"] == 800
