import math

import numpy as np
import pytest

from ridgeline.config import PERCENTILES, RunConfig
from ridgeline.operators import grids, linear, metrics
from ridgeline.plans import report, run
from ridgeline.sources import tables
from ridgeline.sources.synthetic import regression_sample, sparse_beta


def frame(spark, yprd, y, bnrm=None, start=1930):
    rows = [(start * 100 + 100 * (i // 12) + i % 12 + 1, 1, float(a), float(b), float(bnrm[i]) if bnrm is not None else 0.0) for i, (a, b) in enumerate(zip(yprd, y))]
    return spark.createDataFrame(rows, "yyyymm long, k long, yprd double, y double, bnrm double")


def test_seed_metrics(spark):
    rng = np.random.default_rng(1)
    y, f, b = rng.normal(size=60), rng.normal(size=60), rng.uniform(size=60)
    r = metrics.seed_metrics(frame(spark, f, y, b), ["k"]).first()
    tm, n = f * y, 60
    x = np.column_stack([np.ones(n), y])
    coef, *_ = np.linalg.lstsq(x, tm, rcond=None)
    rss = ((tm - x @ coef) ** 2).sum()
    se = math.sqrt(rss / (n - 2) * np.linalg.inv(x.T @ x)[0, 0])
    for got, want in [(r.r2, 1 - (f - y).var(ddof=1) / y.var(ddof=1)), (r.er, tm.mean()), (r.vol, tm.std(ddof=1)), (r.sr, tm.mean() / tm.std(ddof=1)), (r.alpha, coef[0]), (r.alpha_t, coef[0] / se), (r.ir, coef[0] / math.sqrt(rss / (n - 1))), (r.bnrm, b.mean())]:
        assert math.isclose(got, want, rel_tol=1e-9)


def test_r2_anchors(spark):
    y = np.random.default_rng(2).normal(size=40)
    for f, want in ((y, 1.0), (np.zeros(40), 0.0), (y + 3, 1.0), (np.full(40, 5.0), 0.0)):
        assert math.isclose(metrics.seed_metrics(frame(spark, f, y), ["k"]).first().r2, want, abs_tol=1e-12)
    r = metrics.seed_metrics(frame(spark, np.zeros(40), y), ["k"]).first()
    assert r.er == 0 and math.isnan(r.sr)
    assert metrics.classic(frame(spark, y + 3, y), ["k"]).first().r2_classic < 0


def test_subsamples_are_inclusive(spark):
    y = np.arange(48.0)
    df = metrics.with_subsamples(frame(spark, y, y), grids.subsample_frame(spark, ((1931, 1932),)))
    n = {r.subsample: r["count"] for r in df.groupBy("subsample").count().collect()}
    assert n == {"full": 48, "1931-1932": 24}


def test_across_seeds_leaves_nan_out(spark):
    values = [1.0, 2.0, 4.0, 9.0, float("nan")]
    df = spark.createDataFrame([("a", s, v) for s, v in enumerate(values)], "g string, seed long, sr double")
    r = metrics.across_seeds(df, ["g"]).first()
    assert r.n_seeds == 5 and r.sr_mean == 4.0
    for q in PERCENTILES:
        assert math.isclose(r[f"sr_{metrics.percentile_name(q)}"], np.nanpercentile(values, q))


def test_out_of_sample_r2_and_describe(spark):
    rng = np.random.default_rng(3)
    y, f = rng.normal(size=30), rng.normal(size=30)
    past = np.array([y[:t].mean() for t in range(1, 30)])
    want = 1 - ((y - f)[1:] ** 2).sum() / ((y[1:] - past) ** 2).sum()
    assert math.isclose(metrics.out_of_sample_r2(frame(spark, f, y), ["k"]).first().r2_oos, want)
    d = metrics.describe(frame(spark, f, y), ["y"]).first()
    assert d["count"] == 30 and math.isclose(d["std"], y.std(ddof=1)) and math.isclose(d.p25, np.percentile(y, 25)) and d.max == y.max()


def test_report(spark):
    rows = [(12, s, p, lam, p / 100, 0.1, 2.0 if 6 < p < 24 else 1.0) for s in ("full", "x") for p in (2, 6, 8, 12, 24, 700) for lam in (0.001, 1.0)]
    df = spark.createDataFrame(rows, "window long, subsample string, p long, lam double, r2_mean double, sr_mean double, bnrm_mean double")
    r = report.acceptance_bands(df).first()
    assert r.r2_dip == 0.08 and r.r2_tail == 7.0 and math.isclose(r.sr_near, 0.1 * math.sqrt(12)) and r.bnrm_spike == 2.0
    s = report.plot_series(df)
    assert {x.panel for x in s.collect()} == {"r2", "sr", "bnrm"} and s.count() == 36
    assert [x.p for x in report.ranked(df.where("subsample = 'full'"), "r2_mean", 2).collect()] == [700, 700]
    assert "bnrm_spike" not in report.acceptance_bands(df.drop("bnrm_mean")).columns


def test_linear(spark):
    x, y = regression_sample(80, sparse_beta(6, 3, 1), 0.1, 1)
    df = spark.createDataFrame([([float(v) for v in r], float(t)) for r, t in zip(x, y)] + [(None, 1.0)], "v array<double>, y double").repartition(3)
    beta = [r.beta for r in linear.ols(df, "v", "y").orderBy("j").collect()]
    np.testing.assert_allclose(beta, np.linalg.lstsq(x, y, rcond=None)[0], rtol=1e-8)
    np.testing.assert_allclose([r.eigenvalue for r in linear.spectrum(df, "v").orderBy("k").collect()], np.linalg.eigvalsh(x.T @ x / 80), rtol=1e-8)
    wide, t = regression_sample(10, sparse_beta(30, 10, 2), 0.1, 2)
    few = spark.createDataFrame([([float(v) for v in r], float(s)) for r, s in zip(wide, t)], "v array<double>, y double")
    np.testing.assert_allclose([r.beta for r in linear.ridgeless(few, "v", "y").orderBy("j").collect()], np.linalg.pinv(wide) @ t, atol=1e-8)
    np.testing.assert_allclose(linear.least_norm(wide, t), np.linalg.pinv(wide) @ t, atol=1e-8)
    np.testing.assert_allclose(linear.ols_intercept(x, y + 5), np.linalg.lstsq(np.column_stack([np.ones(80), x]), y + 5, rcond=None)[0][1:])
    for a in (x, wide):
        z, v = a - a.mean(axis=0), (y if a is x else t) - (y if a is x else t).mean()
        np.testing.assert_allclose(linear.ridge_fit(a, y if a is x else t, 0.5), np.linalg.solve(z.T @ z + 0.5 * np.eye(a.shape[1]), z.T @ v), atol=1e-8)
    rows = linear.gamma_sweep(spark, wide, t, wide, t, [0.1, 1.0], n=50).collect()
    assert len(rows) == 2 and {r.r2_status for r in rows} <= {"WINNER", "LOSE"}


def test_histogram(spark):
    v = np.random.default_rng(5).normal(size=500)
    got = linear.density_histogram(spark.createDataFrame([(float(x),) for x in v], "x double"), "x", 20).orderBy("bin").toPandas()
    n, edges = np.histogram(v, bins=20)
    assert list(got.n) == list(n)
    np.testing.assert_allclose(got.density, np.histogram(v, bins=20, density=True)[0])
    np.testing.assert_allclose(got.lo, edges[:-1])
    assert linear.density_histogram(spark.createDataFrame([], "x double"), "x").count() == 0


def test_whole_run(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    raw = tables.period_panel(spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet"))
    cfg = RunConfig(windows=(12,), n_seeds=2, max_p=24, out_dir=str(tmp_path), save_predictions=True, subsamples=((1995, 1999),))
    found = run.run(spark, raw, cfg)
    n = len(grids.p_grid(12, 24))
    assert found.count() == 2 * n * 7 and len(found.columns) == 85
    saved = spark.read.parquet(f"{tmp_path}/predictions")
    assert saved.count() == 2 * 30 * n * 7 and {"window", "seed", "date", "p", "lam", "yprd", "bnrm", "y_true"} <= set(saved.columns)
    assert run.parse_args([]) == (RunConfig(), ".")
    given = ["--windows", "12", "24", "--n-seeds", "3", "--max-p", "48", "--save-predictions", "--root", "there", "--lambdas", "0.5", "2"]
    assert run.parse_args(given) == (RunConfig(windows=(12, 24), n_seeds=3, max_p=48, save_predictions=True, lambdas=(0.5, 2.0)), "there")
    with pytest.raises(ValueError):
        RunConfig(dtype="half")
