"""Boosted fits of many rows: a task a model, features summed together, rows by leaf, scores of many rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import boosting as b


def made(seed, n):
    """Two continuous features, and three that follow the month; labels with a few far ones."""
    r = np.random.default_rng(seed)
    month = r.integers(0, 24, n)
    x = np.column_stack([r.normal(size=n), np.sin(month % 12 * np.pi / 6), np.cos(month % 12 * np.pi / 6), r.normal(size=24)[month], r.normal(size=n)])
    x[r.random(n) < 0.1, 4] = np.nan
    y = np.where(x[:, 0] > 0.3, 1.0, -1.0) + x[:, 3] * np.nan_to_num(x[:, 4]) + r.standard_t(3, size=n)
    return b.order_key(x), y


def by_enumeration(keys, y, s, n=None):
    """The same trees from rows as they are, feature by feature and without any list or code."""
    n = np.ones(len(y)) if n is None else n
    edges = []
    for column in keys.T:
        found, which = np.unique(column[column != b.MISSING], return_inverse=True)
        edges.append(b.edges_of(found, np.bincount(which, n[column != b.MISSING]).astype(np.int64), s.bins))
    bins, whole = b.Bins(edges), np.round(y * b.UNIT)
    cells, start, trees = bins.cells(keys), float(whole.sum() / n.sum() / b.UNIT), []
    fitted = np.full(len(y), start)
    for _ in range(s.rounds):
        gradient, steps = np.round(fitted * b.UNIT) * n - whole, b.grow(bins, s)
        tree, node = next(steps)
        try:
            while True:
                own = b.spread(tree, bins, cells, {0: np.arange(len(y))})[node]
                tree, node = steps.send(bins.histogram(cells[own], gradient[own], n[own]))
        except StopIteration as done:
            tree = done.value
        for leaf, own in b.spread(tree, bins, cells, {0: np.arange(len(y))}).items():
            fitted[own] += tree.value[leaf]
        trees.append(tree)
    return start, trees


@pytest.mark.parametrize("leaves,weighted", [(15, False), (40, False), (15, True), (150, False)])
def test_codes_lists_and_marks_grow_the_trees_of_single_rows(leaves, weighted):
    keys, y = made(leaves, 70_000)
    n = np.random.default_rng(1).integers(1, 2000, len(y)) if weighted else None
    y = y * n if weighted else y
    s = b.Boost(rounds=3, leaves=leaves, least=20)
    assert b.fit_one(keys, y, s, n) == by_enumeration(keys, y, s, n)


def test_features_of_the_month_are_summed_together():
    keys, y = made(3, 30_000)
    columns = [np.unique(c, return_inverse=True)[1].astype(np.uint16) for c in np.minimum(keys, 1 << 20).T // 4096]
    bins = b.Bins([np.arange(c.max()) for c in columns])
    rows = b.Rows(columns, bins, np.round(y * b.UNIT), None, 15)
    assert sorted(len(g.members) for g in rows.groups) != [1] * 5 and sorted(f for g in rows.groups for f in g.members) == list(range(5))
    hist = rows.begin(None)
    for f, column in enumerate(columns):
        own = slice(bins.first[f], bins.missing[f] + 1)
        assert (hist[1, own] == np.bincount(column, minlength=bins.missing[f] + 1 - bins.first[f])).all()
        assert (hist[0, own] == np.bincount(column, rows.gradient, bins.missing[f] + 1 - bins.first[f])).all()


def test_columns_are_packed_without_loss():
    keys = b.order_key(np.array([-np.inf, -3.0, -0.0, 1e-30, 7.0, np.inf, np.nan]))
    for column in (keys, keys[:1], keys[6:], np.repeat(keys[1:2], 9)):
        packed = b._packed(column)
        assert (b._codes(packed, len(column)) == np.where(column == b.MISSING, b.NOWHERE, column + b.ZERO)).all()
    assert len(b._packed(np.repeat(keys[1:2], 9))) == 4 and len(b._packed(keys)) == 21


def test_each_model_has_a_task_of_its_own_the_longest_first(spark):
    r = np.random.default_rng(2)
    rows = [(m, [float(v) for v in r.normal(size=2)], float(r.normal())) for m in range(23) for _ in range(40 + m)]
    frame = spark.createDataFrame(rows, "model int, x array<double>, y double").repartition(3)
    got = b.fit(frame, ["model"], b.Boost(rounds=1, leaves=2, least=10)).select("model", "rows", F.spark_partition_id().alias("task")).collect()
    assert len(got) == 23 and [r["model"] for r in sorted(got, key=lambda r: r["task"])] == list(range(22, -1, -1))
    assert all(r["rows"] == 40 + r["model"] for r in got)


def test_many_rows_score_like_few():
    keys, y = made(8, 5000)
    forest = b.Forest(b._flat(len(y), *b.fit_one(keys, y, b.Boost(rounds=20, leaves=20, least=10))))
    assert (forest._many(keys) == np.concatenate([forest._few(keys[i:i + 100]) for i in range(0, 5000, 100)])).all()
