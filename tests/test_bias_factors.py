"""Bias factors over many origins store each row once."""
import pytest

from tidepanel.operators import quantiles, selection
from tidepanel.session import cut_lineage


def rows_of_fc():
    return [(i, h, t - h, t, 100.0 + (i * 37 + t * 11 + h) % 41, 100.0 + (i * 13 + t * 7) % 29) for i in range(20) for h in (1, 2) for t in range(20, 34) if (i + t) % 5]


def reached(pairs):
    """First value, in order, whose cumulative weight reaches half."""
    total, cum = sum(w for _, w in pairs), 0.0
    for ratio, w in sorted(pairs):
        cum += w
        if cum >= total / 2:
            return ratio


@pytest.mark.parametrize("window", [None, 3])
def test_bias_factors(spark, monkeypatch, window):
    rows, stored = rows_of_fc(), []

    def count(df, label):
        out = cut_lineage(df, label)
        stored.append(out.count())
        return out

    for module in (selection, quantiles):
        monkeypatch.setattr(module, "cut_lineage", count, raising=False)
    fc = spark.createDataFrame(rows, "id long, horizon int, origin int, target int, actual double, predicted double")
    got = {(r["horizon"], r["origin"], r["id"]): r for r in selection.bias_factors(fc, "local", window).collect()}
    assert max(stored) <= len(rows)  # not a row for every origin
    clip = lambda x: min(max(x, 0.85), 1.15)
    assert set(got) == {(h, o, i) for i, h, o, *_ in rows}
    for (h, o, i), r in got.items():
        near = [(a / p, p, t, j) for j, g, _, t, a, p in rows if g == h and t <= o and (window is None or t > o - window)]
        assert r["dates"] == len({t for *_, t, _ in near})
        if r["dates"] < 2:
            assert (r["global_factor"], r["factor"]) == (1.0, 1.0)
            continue
        overall, own = clip(reached([x[:2] for x in near])), [x[:2] for x in near if x[3] == i]
        assert r["global_factor"] == pytest.approx(overall)
        n = len(own)
        want = clip(n / (n + 3) * reached(own) + (1 - n / (n + 3)) * overall) if n >= 2 else overall
        assert r["factor"] == pytest.approx(want)
    assert {(r["horizon"], r["origin"]): r["factor"] for r in selection.bias_factors(fc, "global", window).collect()} == {
        k[:2]: r["global_factor"] for k, r in got.items()}
