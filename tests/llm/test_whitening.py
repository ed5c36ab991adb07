"""Whitening against dense algebra: polynomials by Faddeev-LeVerrier, components by numpy, exact deviations, odd tables."""
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.conftest import SF
from tidepanel.llm import whitening as w


def leverrier(m):
    d = len(m)
    eye = [[int(i == j) for j in range(d)] for i in range(d)]
    times = lambda a, b: [[sum(x * y for x, y in zip(row, col)) for col in zip(*b)] for row in a]
    c, n = [0] * d + [1], [[0] * d for _ in range(d)]
    for k in range(1, d + 1):
        n = [[x + c[d - k + 1] * y for x, y in zip(r, s)] for r, s in zip(times(m, n), eye)]
        c[d - k] = Fraction(-sum(times(m, n)[i][i] for i in range(d)), k)
    return [int(v) for v in c]


def psd(seed, d, rank, size):
    r = np.random.default_rng(seed)
    a = r.integers(-size, size, (d, rank)).astype(object)
    return (a @ a.T).tolist()


@pytest.mark.parametrize("m", [psd(1, 7, 9, 50), psd(2, 6, 3, 10**9), [[5]], [[2, 0], [0, 2]], [[0, 0, 0], [0, 3, 0], [0, 0, 0]], psd(3, 9, 9, 2)])
def test_polynomial_is_exact(spark, m):
    assert w.polynomial(spark, m) == leverrier(m)


def test_roots_with_multiplicity_and_close_ones():
    assert w.find_root([-6, 11, -6, 1], 2)[:1] != () and [round(w.find_root([-6, 11, -6, 1], r)[0] / 2 ** w.find_root([-6, 11, -6, 1], r)[1]) for r in (1, 2, 3)] == [3, 2, 1]
    m = [[4, 0, 0, 0], [0, 4, 0, 0], [0, 0, 9, 0], [0, 0, 0, 1]]
    poly = leverrier(m)
    assert [w.find_root(poly, r)[2:4] for r in (1, 2, 3, 4)] == [(1, 1), (2, 3), (2, 3), (4, 4)]
    vectors = np.array([w.component(m, poly, 1, r)[2] for r in (1, 2, 3, 4)])
    assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-15) and np.allclose(vectors @ np.array(m) @ vectors.T, np.diag([9, 4, 4, 1]), atol=1e-12)
    near = [[10**30, 1], [1, 10**30]]  # 10^30 ± 1
    (a, bits, first, last, _), poly = w.find_root(leverrier(near), 2), leverrier(near)
    assert (first, last) == (2, 2) and abs(Fraction(a, 2**bits) - (10**30 - 1)) < Fraction(1, 10**9)
    assert np.allclose(np.abs(w.component(near, poly, 1, 1)[2]), 0.5**0.5)


def plain(x, most=32):
    z = x - x.mean(axis=0)
    e, v = np.linalg.eigh(z.T @ z / len(z))
    order = np.argsort(-e)[:most]
    return z @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_query_equals_dense_algebra(spark):
    got = w.op13_embedding_whitening(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.array(table.embedding.tolist(), float)).astype(np.int64) + 1_000_000
    want, share = plain(x.astype(float))
    z = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    sign = np.sign((z * want).sum(axis=0))
    assert z.shape == want.shape and np.abs(z - want * sign).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), share, rtol=1e-12) and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-12
    n, s = len(x), x.sum(axis=0)
    assert (got[got.component == 1].set_index("vec_id").deviation.loc[table.vec_id].to_numpy() == ((n * x - s) ** 2).sum(axis=1)).all()


def test_odd_rows(spark):
    shape = "vec_id long, embedding array<double>, key string, vector int, n int, w double"
    bad = [None, [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [1.0, float("inf"), 0.0]]
    good = [[0.5, 1.0, 2.0], [0.25, 7.0, 1.0], [3.0, 1.0, -2.0], [3.0, 1.0, -2.0], [-1.0, 4.0], [0.1, -0.1, 9.5]]
    rows = [(i, v, "k", 1, 2, 3.0) for i, v in enumerate(bad + good)] + [(None, [2.0, 2.0, 2.5], "k", 1, 2, 3.0)]
    frame = spark.createDataFrame(rows, shape).repartition(3)
    got = w.whiten(frame).toPandas()
    x = np.floor(64 * np.array([v + [0.0] * (3 - len(v)) for v in good] + [[2.0, 2.0, 2.5]])) + 1_000_000
    want, _ = plain(x)
    assert len(got) == 7 * 3 and got.vec_id.isna().sum() == 3 and (got.n == 7).all()
    mine = got.dropna().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(mine) - np.abs(want[:6])).max() < 1e-12
    assert w.whiten(frame.limit(0)).count() == 0 and w.whiten(frame.where("vec_id < 4")).count() == 0
    assert w.whiten(frame.where("vec_id in (6, 7)")).count() == 0  # equal vectors have no components
    flat = w.whiten(frame.where("vec_id in (4, 5, 6)")).collect()  # three points span two dimensions
    assert {r["component"] for r in flat} == {1, 2} and flat[0]["identity_error"] < 1e-12


def test_huge_entries_stay_exact(spark):
    r = np.random.default_rng(3)
    values = (r.integers(-2**40, 2**40, (50, 3)) / 64.0).tolist()
    got = w.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "vec_id long, embedding array<double>")).collect()
    x = np.floor(64 * np.array(values)).astype(np.int64).astype(object)
    n, s = len(x), x.sum(axis=0)
    exact = ((n * x - s) ** 2).sum(axis=1)
    assert all(g["deviation"] == (exact[g["vec_id"]] if exact[g["vec_id"]] < 2**63 else None) for g in got)
    assert got[0]["identity_error"] < 1e-10
    edge = w.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert len(edge) == 6 and all(np.isfinite(g["whitened"]) for g in edge)
