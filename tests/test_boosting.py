"""Histogram boosting: splits against enumeration, one-task and summed growth, missing values, causality."""
import numpy as np
import pytest

from tidepanel.operators import boosting as b
from tidepanel.operators import learned


def made(seed, n, missing=0.1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 4)), 1)
    y = np.where(x[:, 0] > 0.3, 1.0, -1.0) * x[:, 1] + 0.5 * x[:, 2] + 0.1 * r.normal(size=n)
    x[r.random(x.shape) < missing] = np.nan
    return x, y


def test_keys_keep_the_order():
    x = np.array([-1e30, -5.0, -1e-20, -0.0, 0.0, 1e-20, 0.5, 5.0, 1e30, np.inf, np.nan])
    k = b.order_key(x)
    assert (np.diff(k) >= 0).all() and k[3] == k[4] and k[-1] == b.MISSING and k[-2] < b.MISSING - 1 and k[6] < k[7]


def enumerated(x, y, s):
    """Best first split by trying every feature, value and side."""
    best = (0.0, None)
    gradient = y.mean() - y
    loss = lambda own: gradient[own].sum() ** 2 / (own.sum() + s.l2)
    for f in range(x.shape[1]):
        for v in np.unique(x[~np.isnan(x[:, f]), f]):
            for side in (False, True):
                left = (x[:, f] <= v) | (np.isnan(x[:, f]) & side)
                if min(left.sum(), (~left).sum()) >= s.least:
                    gain = loss(left) + loss(~left) - loss(np.ones(len(y), bool))
                    if gain > best[0] + 1e-9:
                        best = (gain, left)
    left = best[1]
    return y.mean() + np.where(left, -s.rate * gradient[left].sum() / (left.sum() + s.l2), -s.rate * gradient[~left].sum() / ((~left).sum() + s.l2))


@pytest.mark.parametrize("seed", range(4))
def test_first_split_is_the_best_of_all(seed):
    s = b.Boost(rounds=1, leaves=2, least=20)
    x, y = made(seed, 200)
    forest = b.Forest(b._flat(len(y), *b.fit_one(b.order_key(x), y, s)))
    assert np.allclose(forest(x), enumerated(x, y, s), atol=1e-5)


def test_leaves_rows_and_learning():
    x, y = made(9, 3000)
    start, trees = b.fit_one(b.order_key(x), y, b.Boost(rounds=120))
    forest = b.Forest(b._flat(len(y), start, trees))
    assert max(len(t.feature) for t in trees) <= 29 and np.mean((forest(x) - y) ** 2) < 0.25 * y.var()
    fresh, told = made(10, 1000)
    assert np.mean((forest(fresh) - told) ** 2) < 0.4 * told.var()
    root = trees[0]
    leaf = b.spread(root, bins := b.Bins([b.edges_of(*np.unique(c[c != b.MISSING], return_counts=True), 255) for c in b.order_key(x).T]), bins.cells(b.order_key(x)), {0: np.arange(len(y))})
    assert min(map(len, leaf.values())) >= 60 and sum(map(len, leaf.values())) == len(y)


@pytest.fixture(scope="module")
def models(spark):
    rows = []
    for m, n in ((1, 400), (2, 900), (3, 30)):
        x, y = made(m, n)
        rows += [(m, "k", [None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y)]
    rows += [(9, "k", [1.0, 2.0, 3.0, None], None)]
    return spark.createDataFrame(rows, "model int, kind string, x array<double>, y double").repartition(5)


@pytest.mark.parametrize("bins", [255, 7])
def test_summed_histograms_grow_the_same_trees(models, bins):
    s = b.Boost(rounds=3, leaves=5, least=20, bins=bins)
    read = lambda limit: {r["model"]: r for r in b.fit(models, ["model", "kind"], s, task_rows=limit).collect()}
    small, mixed, large = read(10**6), read(500), read(0)
    assert set(small) == {1, 2, 3} and small == mixed == large
    assert small[3]["rows"] == 30 and small[3]["feature"] == [-1]  # too few rows to split


def test_rows_of_equal_features_may_be_summed_before(models, spark):
    s = b.Boost(rounds=3, leaves=5, least=20)
    whole = models.filter("y is not null").selectExpr("model", "kind", "transform(x, v -> round(v)) x", "round(64 * y) / 64 y")
    few = whole.groupBy("model", "kind", "x").agg({"y": "sum", "*": "count"}).withColumnsRenamed({"sum(y)": "y", "count(1)": "n"})
    read = lambda rows, limit, weight=None: {r["model"]: r for r in b.fit(rows, ["model", "kind"], s, task_rows=limit, weight=weight).collect()}
    assert few.count() < whole.count()
    assert read(whole, 10**6) == read(few, 10**6, "n") == read(few, 0, "n")


def test_blocks_meet_the_origins_like_their_rows(spark):
    x, y = made(5, 600)
    rows = spark.createDataFrame([(FIRST + i % 20, 1 + 2 * (i % 2), [None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "source int, horizon int, x array<double>, y double").repartition(3)
    s, keys, origins = b.Boost(rounds=3, leaves=5, least=20), ["origin", "horizon"], [FIRST + 9, FIRST + 15]
    read = lambda fitted: {(r["origin"], r["horizon"]): r for r in fitted.collect()}
    assert read(b.fit(learned._per_origin(rows, origins), keys, s)) == read(b.fit_packed(learned._blocks_per_origin(rows, origins), keys, s))


def test_predictions_by_model(models):
    keys = ["model", "kind"]
    fitted = b.forests(b.fit(models, keys, b.Boost(rounds=5, least=20)), keys)
    rows = b.predict(models, keys, fitted).collect()
    assert len(rows) == models.count() and all((r["raw"] is None) == (r["model"] == 9) for r in rows)
    own = [r for r in rows if r["model"] == 2]
    assert np.allclose([r["raw"] for r in own], fitted[2, "k"](np.array([[np.nan if v is None else v for v in r["x"]] for r in own])))


FIRST = 12 * 2000


def panel(spark, months=30, ids=30, change=None):
    r = np.random.default_rng(1)
    rows = [(i, FIRST + m, float(100 * (1 + i) * np.exp(0.02 * m + 0.2 * np.sin(m / 2) + 0.05 * r.normal()))) for i in range(ids) for m in range(months)]
    return spark.createDataFrame([(i, m, v * (change if change and m > FIRST + 17 else 1)) for i, m, v in rows], "id long, m int, value double")


def test_direct_models_do_not_see_the_future(spark):
    regions = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, region long")
    s = b.Boost(rounds=4, least=10)
    read = lambda p: sorted((r["id"], r["origin"], r["horizon"], r["status"], round(r["predicted"], 9)) for r in learned.fit_direct_horizon(
        p, regions, FIRST, [FIRST + 12, FIRST + 17], [1, 12], True, minimum_rows=60, settings=s).collect())
    before = read(panel(spark))
    assert before == read(panel(spark, change=50.0))
    assert {(r[1] - FIRST, r[2], r[3]) for r in before} == {(12, 1, "trained"), (12, 12, "seasonal_fallback"), (17, 1, "trained"), (17, 12, "trained")}
    roll = lambda p: sorted((r["id"], r["origin"], r["horizon"], round(r["predicted"], 9)) for r in learned.fit_recursive_growth(p, [FIRST + 12, FIRST + 17], 12, settings=s).collect())
    rolled = roll(panel(spark))
    assert rolled == roll(panel(spark, change=50.0)) and len(rolled) == 30 * 2 * 12


def test_category_features_and_corrections(spark):
    p = panel(spark)
    cats = p.selectExpr("id", "m", "'a' category", "value").unionByName(p.filter("id > 3").selectExpr("id", "m", "'b' category", "if(m % 5 = 0, 0, 2 * value) value"))
    extra = learned.category_growth(cats, ["a", "b"])
    rows = {(r["id"], r["m"]): r for r in extra.collect()}
    assert rows[1, FIRST + 3]["g_b"] is None and rows[5, FIRST + 6]["g_b"] is None and abs(rows[5, FIRST + 8]["g_b"] - rows[5, FIRST + 8]["g_a"]) < 1e-12
    fc = p.crossJoin(spark.createDataFrame([(1,), (3,)], "horizon int")).selectExpr("id", "m - horizon as origin", "m as target", "horizon", "value as actual", "value * (1 + id / 100.0) as predicted")
    for kind in ("ridge", "boosted"):
        out = learned.fit_residual_correction(fc, p, FIRST + 20, kind, 0.001, b.Boost(rounds=60, least=20), extra=extra).collect()
        error = lambda c: np.mean([abs(r[c] / r["actual"] - 1) for r in out])
        assert min(r["origin"] for r in out) == FIRST + 20 and error("predicted") < 0.5 * error("base")
