import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.config import PREDICTORS, RAW_COLUMNS
from ridgeline.functions.numeric import finite_or_null, ieee_div
from ridgeline.operators import predictors, scaling
from ridgeline.sources import tables


def series(spark, values, name="x", start=1):
    return spark.createDataFrame([(start + i, None if v is None else float(v)) for i, v in enumerate(values)], f"yyyymm long, {name} double")


def got(df, name):
    return [r[name] for r in df.orderBy("yyyymm").collect()]


def raw_table(n=80, seed=1):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({c: rng.uniform(0.5, 2, n) for c in RAW_COLUMNS})
    df["yyyymm"] = np.arange(n)
    return df


def test_ieee_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 0.0), (1.0, None), (float("nan"), 0.0)], "n double, d double")
    v = [r[0] for r in df.select(ieee_div(F.col("n"), F.col("d"))).collect()]
    assert v[0] == math.inf and v[1] == -math.inf and math.isnan(v[2]) and v[3] == 1.5 and v[4] is None and v[5] is None and math.isnan(v[6])
    assert [r[0] for r in df.select(finite_or_null(F.col("n"))).collect()][-1] is None


def test_euro_csv(spark, tmp_path):
    path = tmp_path / "15-predictors.csv"
    head = ",".join(RAW_COLUMNS)
    row = lambda m, first: ",".join([str(m), f'"{first}"', '"4,44"', '"1,2E-05"', "NaN", ""] + ['"0,5"'] * (len(RAW_COLUMNS) - 6))
    path.write_text("\n".join([head, row(202412, "5.881,63"), row(187101, "4,44")]))
    a, b = tables.predictors_csv(spark, str(path)).collect()
    assert (a.yyyymm, b.yyyymm) == (187101, 202412) and b["Index"] == 5881.63 and a["Index"] == 4.44
    assert b["D12"] == 4.44 and b["E12"] == 1.2e-5 and b["b/m"] is None and b["tbl"] is None
    bad = tmp_path / "bad.csv"
    bad.write_text("yyyymm,Index\n1,2")
    with pytest.raises(ValueError, match="lacks"):
        tables.predictors_csv(spark, str(bad))


def test_data_dir_and_factors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.data_dir(spark, str(tmp_path))
    (tmp_path / "src" / "data").mkdir(parents=True)
    for n in ("15-predictors.csv", "fama-french-return.csv"):
        (tmp_path / "src" / "data" / n).write_text("yyyymm,Mkt-RF,RF\n192608,2.64,0.25\n192607,2.96,0.22")
    d = tables.data_dir(spark, str(tmp_path))
    assert d.endswith("/src/data")
    rows = tables.factors_csv(spark, d + "/fama-french-return.csv").collect()
    assert [(r.yyyymm, r["Mkt-RF"]) for r in rows] == [(192607, 2.96), (192608, 2.64)]
    assert tables.parquet_if_there(spark, str(tmp_path / "none")) is None


def test_lags_and_complete_rows(spark):
    raw = raw_table()
    raw.loc[10, "svar"] = np.nan
    df = spark.createDataFrame(raw).withColumn("svar", F.nanvl("svar", F.lit(None)))
    out = predictors.lagged_xy(df).orderBy("yyyymm").toPandas().set_index("yyyymm")
    y = raw.CRSP_SPvw - raw.Rfree
    want = pd.DataFrame({"dfy": raw.BAA - raw.AAA, "de": np.log(raw.D12) - np.log(raw.E12), "dy": np.log(raw.D12) - np.log(raw.Index.shift(1)), "bm": raw["b/m"], "svar": raw.svar}).shift(1)
    assert 11 not in out.index and out.index[0] == 2 and len(out) == 77
    for c in want:
        np.testing.assert_allclose(out[c], want[c].loc[out.index])
    np.testing.assert_allclose(out.lag_mkt, y.shift(1).loc[out.index])
    np.testing.assert_allclose(out.y, y.loc[out.index])
    assert list(out.columns) == [*PREDICTORS, "lag_mkt", "y"]


def test_series_are_apart(spark):
    a, b = raw_table(60, 1), raw_table(60, 2)
    both = spark.createDataFrame(pd.concat([a.assign(s="a"), b.assign(s="b")])).repartition(5)
    together = scaling.prepare(both, by=("s",)).where("s = 'b'").drop("s").orderBy("t").toPandas()
    alone = scaling.prepare(spark.createDataFrame(b)).orderBy("t").toPandas()
    pd.testing.assert_frame_equal(together, alone)


def test_expanding_std(spark):
    x = np.random.default_rng(3).normal(5, 2, 80)
    out = np.array(got(scaling.expanding_std(series(spark, x), ["x"]), "x"))
    for t in range(80):
        np.testing.assert_allclose(out[t], x[t] / x[: max(36, t + 1)].std(ddof=1))
    holes = [None if i == 7 else float("inf") if i == 40 else v for i, v in enumerate(x)]
    out = got(scaling.expanding_std(series(spark, holes), ["x"]), "x")
    ok = np.array([v for i, v in enumerate(x[:61]) if i not in (7, 40)])
    assert out[7] is None and math.isclose(out[60], x[60] / ok.std(ddof=1))
    with pytest.raises(ValueError):
        scaling.expanding_std(series(spark, x[:20]), ["x"], check=True)


def test_trailing_rms(spark):
    y = np.random.default_rng(4).normal(size=40)
    out = got(scaling.trailing_rms(series(spark, y), "x"), "x")
    assert out[:12] == [None] * 12
    for t in range(12, 40):
        assert math.isclose(out[t], y[t] / np.sqrt(np.mean(y[t - 12 : t] ** 2)))


def test_causal_under_perturbation(spark):
    y = np.random.default_rng(5).normal(size=60)
    z = y.copy()
    z[50] += 10
    for how in (lambda d: scaling.expanding_std(d, ["x"]), lambda d: scaling.trailing_rms(d, "x"), lambda d: scaling.expanding_zscore(d, ["x"])):
        a, b = got(how(series(spark, y)), "x"), got(how(series(spark, z)), "x")
        assert a[:50] == b[:50] and a[50] != b[50]
    a, b = got(scaling.trailing_rms(series(spark, y), "x"), "x"), got(scaling.trailing_rms(series(spark, z), "x"), "x")
    assert math.isclose(b[50] / a[50], z[50] / y[50])


def test_zscores(spark):
    x = pd.Series(np.random.default_rng(6).normal(size=60))
    a = np.array([np.nan if v is None else v for v in got(scaling.expanding_zscore(series(spark, x), ["x"]), "x")])
    np.testing.assert_allclose(a, (x - x.expanding(36).mean()) / x.expanding(36).std())
    b = np.array([np.nan if v is None else v for v in got(scaling.rolling_zscore(series(spark, x), "x"), "x")])
    np.testing.assert_allclose(b, (x - x.rolling(12).mean()) / x.rolling(12).std())


def test_older_lags_and_factors(spark):
    df = series(spark, [1, 2, None, 4, 5]).withColumn("y", F.col("yyyymm") * 10.0)
    assert [(r.yyyymm, r.x) for r in predictors.lag_complete(df, ["x"], "y").orderBy("yyyymm").collect()] == [(2, 1.0), (3, 2.0), (5, 4.0)]
    assert [r.yyyymm for r in predictors.with_factors(series(spark, [1, 2, 3]), series(spark, [7, 8], "f", 2)).collect()] == [2, 3]
