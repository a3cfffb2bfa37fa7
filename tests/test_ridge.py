import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.config import LAMBDAS, RunConfig
from ridgeline.operators import grids, random_features, ridge, ridge_sql
from ridgeline.sources.synthetic import draw_weights, regression_sample, signal, sparse_beta


def primal(x, y, window, grid, lambdas, weights, gamma=2.0):
    """Ridge from its definition: one regression for each row, grid point and penalty, in feature space."""
    out = np.zeros((2, len(y) - window, len(grid), len(lambdas)))
    for i, p in enumerate(grid):
        g = gamma * x @ weights[: p // 2].T
        z = np.hstack([np.cos(g), np.sin(g)])
        for k in range(len(y) - window):
            s = z[k : k + window].std(axis=0, ddof=1)
            a, b = z[k : k + window] / s, z[k + window] / s
            for j, lam in enumerate(lambdas):
                beta = np.linalg.solve(a.T @ a + lam * window * np.eye(a.shape[1]), a.T @ y[k : k + window])
                out[:, k, i, j] = beta @ b, beta @ beta
    return out


def toy(n=60, d=4, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)), rng.normal(size=n)


def test_kernel_is_primal_ridge():
    x, y = toy()
    w, grid = draw_weights(9, 4, 30), [2, 8, 12, 13, 24, 60]
    got = ridge.fit_rows(x, y, 12, 60, window=12, grid=grid, lambdas=LAMBDAS, weights=w)
    want = primal(x, y, 12, grid, LAMBDAS, w)
    np.testing.assert_allclose(got[0], want[0], rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(got[1], want[1], rtol=1e-5, atol=1e-8)


def test_blocks_and_chunks_change_nothing():
    x, y = toy()
    how = dict(window=12, grid=[2, 9, 24, 60], lambdas=(0.01, 1.0), weights=draw_weights(9, 4, 30))
    whole = ridge.fit_rows(x, y, 12, 60, **how)
    parts = [ridge.fit_rows(x, y, a, min(a + 7, 60), block=5, **how) for a in range(12, 60, 7)]
    for i in (0, 1):
        np.testing.assert_allclose(np.concatenate([p[i] for p in parts]), whole[i], rtol=1e-8, atol=1e-10)


def test_alignment_and_precision():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(120, 3)), draw_weights(1, 3, 3)
    g = 2.0 * x @ w.T
    y = np.hstack([np.cos(g), np.sin(g)]) @ rng.normal(size=6)
    got, _ = ridge.fit_rows(x, y, 20, 120, window=20, grid=[6], lambdas=[1e-10], weights=w)
    assert np.abs(got[:, 0, 0] - y[20:]).max() < 1e-5
    how = dict(window=12, grid=[24], lambdas=[1.0], weights=draw_weights(1, 3, 12))
    a, b = (ridge.fit_rows(x, y, 12, 120, dtype=d, **how)[0] for d in ("float64", "float32"))
    np.testing.assert_allclose(a, b, atol=5e-3)


def test_fallback_without_eigenvalues(monkeypatch):
    x, y = toy()
    how = dict(window=12, grid=[2, 24], lambdas=LAMBDAS, weights=draw_weights(9, 4, 12))
    want = ridge.fit_rows(x, y, 12, 60, **how)

    def fail(_):
        raise np.linalg.LinAlgError

    monkeypatch.setattr(np.linalg, "eigh", fail)
    got = ridge.fit_rows(x, y, 12, 60, **how)
    np.testing.assert_allclose(got[0], want[0], rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(got[1], want[1], rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("bad", [dict(window=1), dict(grid=[24, 2]), dict(weights=draw_weights(9, 4, 3)), dict(window=70)])
def test_guards(bad):
    x, y = toy()
    with pytest.raises(ValueError):
        ridge.fit_rows(x, y, 12, 60, **(dict(window=12, grid=[2, 24], lambdas=[1.0], weights=draw_weights(9, 4, 12)) | bad))


def test_a_feature_that_does_not_vary_is_named():
    x, y = toy()
    with pytest.raises(ValueError, match="does not vary"):
        ridge.fit_rows(np.zeros_like(x), y, 12, 60, window=12, grid=[2], lambdas=[1.0], weights=draw_weights(9, 4, 1))


def sample(spark, n=60, d=4):
    x, y = toy(n, d)
    return x, y, spark.createDataFrame([(i + 1, 200001 + i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "t long, yyyymm long, " + ", ".join(f"x{i} double" for i in range(d)) + ", y double")


def test_distributed_sweep(spark):
    x, y, df = sample(spark)
    cfg = RunConfig(windows=(12,), n_seeds=2, first_seed=5, max_p=24, chunk_windows=7)
    got = ridge.rolling_ridge(df, ["x0", "x1", "x2", "x3"], cfg).orderBy("seed", "t", "pi", "lam").toPandas()
    grid = grids.p_grid(12, 24)
    assert len(got) == 2 * 48 * len(grid) * 7 and list(got.p.unique()) == grid
    for s in (5, 6):
        want = ridge.fit_rows(x, y, 12, 60, window=12, grid=grid, lambdas=LAMBDAS, weights=draw_weights(s, 4, 12))[0]
        np.testing.assert_allclose(got[got.seed == s].yprd, want.ravel(), rtol=1e-8, atol=1e-10)
    with pytest.raises(ValueError, match="shorter"):
        ridge.rolling_ridge(df.limit(10), ["x0"], cfg)


@pytest.mark.parametrize("window", [12, 60, 120])
def test_many_series_at_once(spark, window):
    """Each series as if alone, for all published windows, whatever the chunks."""
    frames = []
    for k, n in enumerate((window + 1, window + 30, window + 47)):
        frames.append(sample(spark, n)[2].selectExpr(f"'s{k}' AS name", "t + 100 AS t", "yyyymm", f"x0 * {k + 1} AS x0", "x1", "x2", "x3", "y"))
    cfg = RunConfig(windows=(window,), n_seeds=2, max_p=2 * window, lambdas=(0.1, 10.0), chunk_windows=20)
    together = ridge.rolling_ridge(frames[0].union(frames[1]).union(frames[2]).repartition(5), ["x0", "x1", "x2", "x3"], cfg, by=("name",))
    order = ["name", "seed", "t", "pi", "lam"]
    got = together.toPandas().sort_values(order).reset_index(drop=True)
    alone = [ridge.rolling_ridge(f.drop("name"), ["x0", "x1", "x2", "x3"], cfg).toPandas().assign(name=f"s{k}") for k, f in enumerate(frames)]
    want = pd.concat(alone).sort_values(order).reset_index(drop=True)[got.columns]
    pd.testing.assert_frame_equal(got, want, rtol=1e-8)
    assert got.groupby("name").t.nunique().tolist() == [1, 30, 47]
    with pytest.raises(ValueError, match="shorter"):
        ridge.rolling_ridge(frames[0].union(frames[1].limit(window)), ["x0"], cfg, by=("name",))


@pytest.mark.parametrize("half", [1, 2, 3])
def test_window_functions_agree_with_primal(spark, half):
    x, y, df = sample(spark)
    w = draw_weights(3, 4, half)
    z = random_features.features(df, ["x0", "x1", "x2", "x3"], w)
    got = ridge_sql.rolling_ridge(z.repartition(4), 12, 0.1).orderBy("t").toPandas()
    want = primal(x, y, 12, [2 * half], [0.1], w)
    np.testing.assert_allclose(got.yprd, want[0].ravel(), atol=1e-9)
    np.testing.assert_allclose(got.bnrm, want[1].ravel(), rtol=1e-7)


def test_grids(spark):
    assert [len(grids.p_grid(t)) for t in (12, 60, 120)] == [165, 91, 82]
    assert grids.p_grid(12)[:8] == [2, 5, 6, 7, 8, 10, 12, 14] and grids.p_grid(12)[-1] == 12_000
    assert grids.p_grid(12, 24)[-1] == 24 and grids.feature_count(13) == 12 and grids.feature_count(12) == 12
    for bad in (lambda: grids.p_grid(9), lambda: grids.grid_frame(spark, (12, 9)), lambda: grids.multiples(0, 10)):
        with pytest.raises(ValueError):
            bad()
    frame = grids.grid_frame(spark, (12, 60, 120), 12_000).orderBy("window", "pi").collect()
    for t in (12, 60, 120):
        assert [r.p for r in frame if r.window == t] == grids.p_grid(t) and all(r.half == r.p // 2 for r in frame)
    assert [r.p for r in grids.grid_frame(spark, (12,), 24).orderBy("pi").collect()] == grids.p_grid(12, 24)
    assert grids.multiples(12, 40) == [12, 24, 36]


def test_weights_and_features():
    a, b = draw_weights(7, 3, 5), draw_weights(7, 3, 50)
    assert np.array_equal(a, b[:5]) and not np.array_equal(a, draw_weights(8, 3, 5))
    big = draw_weights(1, 20, 5000)
    assert abs(big.mean()) < 0.02 and abs(big.std() - 1) < 0.02
    x = np.random.default_rng(1).normal(size=(6, 3))
    z = random_features.scaled_features(x, 4000, 0.5)
    k = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    np.testing.assert_allclose(z @ z.T, k, atol=0.06)
    np.testing.assert_allclose(random_features.phase_features(x, 20000, 0.5) @ random_features.phase_features(x, 20000, 0.5).T, k, atol=0.06)
    beta = sparse_beta(30, 4, 1)
    xs, ys = regression_sample(20, beta, 0.0, 1)
    np.testing.assert_allclose(ys, xs @ beta)
    assert (beta[4:] == 0).all() and (beta[:4] != 0).all()
    np.testing.assert_allclose(regression_sample(20, beta, 0.0, 1, curved=True)[1], (xs @ beta) ** 2 / 4)
    noisy = regression_sample(4000, beta, 0.5, 1)
    assert abs(np.std(noisy[1] - signal(noisy[0], beta)) - 0.5) < 0.03


def test_projection_scales_with_gamma(spark):
    x, _, df = sample(spark, 10)
    w = draw_weights(2, 4, 3)
    one, two = (df.select(*random_features.projection(["x0", "x1", "x2", "x3"], w, g)).toPandas().to_numpy() for g in (1.0, 2.0))
    np.testing.assert_allclose(one, x @ w.T)
    np.testing.assert_allclose(two, 2 * one)
    assert df.select(F.count("*")).first()[0] == 10
