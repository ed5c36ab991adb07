"""Segmentations of many series at once are those of each series alone."""
import numpy as np
import pytest

from tidepanel.operators import detectors


@pytest.mark.parametrize("cost, low, high", [("l2", 1.0, 64.0), ("l2", 0.05, 4.0), ("rbf", 0.1, 8.0)])
def test_many_series_at_once(cost, low, high):
    r = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 7, 40):
        x = r.normal(size=(25, n)) + 3 * (np.arange(n) > n * r.random((25, 1))) - 2 * (np.arange(n) > n * r.random((25, 1)))
        for one, many in zip(x, detectors.segment_paths(x, low, high, cost)):
            alone = detectors.segment_path(one, low, high, cost)
            assert [p[2] for p in many] == [p[2] for p in alone]
            assert np.allclose([[p[0], p[1], p[3]] for p in many], [[p[0], p[1], p[3]] for p in alone], atol=1e-9)


def test_a_thousand_series_take_few_searches(monkeypatch):
    asked = []
    whole = detectors._best_of_each
    monkeypatch.setattr(detectors, "_best_of_each", lambda *a: asked.append(1) or whole(*a))
    paths = detectors.segment_paths(np.random.default_rng(4).normal(size=(1000, 30)), 1.0, 64.0)
    assert len(paths) == 1000 and len(asked) < 20
