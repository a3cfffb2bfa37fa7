"""Regressions and spectra of wide tables: moments are summed by Spark, only d x d results meet on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a vector of which the moments still fit the driver (d x d doubles).
MOST_COLUMNS = 4096


def cross_moments(df: DataFrame, vector: str, target: str | None = None) -> DataFrame:
    """(i, j, s, n): sums of products of a vector column's components, i <= j; the target, if given, is component -1.

    Each task sums its rows in one matrix product and hands on a triangle; a groupBy adds the triangles.
    Rows with a null vector or component, or a null target, take no part; a vector of another length is an error.
    """
    cols = [vector] + ([target] if target else [])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for f in frames:
            x = np.stack(f[vector].to_numpy()).astype(np.float64) if len(f) else None
            if x is None:
                continue
            if x.shape[1] > MOST_COLUMNS:
                raise ValueError(f"vectors of over {MOST_COLUMNS} components")
            if target:
                x = np.column_stack([f[target].to_numpy(float), x])
            total = x.T @ x if total is None else total + x.T @ x
            n += len(x)
        if total is not None:
            i, j = np.triu_indices(len(total))
            shift = 1 if target else 0
            yield pd.DataFrame({"i": i - shift, "j": j - shift, "s": total[i, j], "n": n})

    ok = df.where(F.forall(vector, lambda x: x.isNotNull()) & (F.col(target).isNotNull() if target else F.lit(True)))
    return ok.select(*cols).mapInPandas(run, "i int, j int, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, cov): X'X / rows, not centred, i <= j."""
    return cross_moments(df, vector).select("i", "j", (F.col("s") / F.col("n")).alias("cov"))


def _matrix(rows: list, key: str) -> np.ndarray:
    d = 1 + max((r.j for r in rows), default=-1)
    out = np.zeros((d, d))
    for r in rows:
        if r.i >= 0:
            out[r.i, r.j] = out[r.j, r.i] = r[key]
    return out


def spectrum(df: DataFrame, vector: str) -> DataFrame:
    """(k, eigenvalue) of the covariance, rising."""
    values = np.linalg.eigvalsh(_matrix(covariance(df, vector).collect(), "cov"))
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, eigenvalue double")


def _solve(df: DataFrame, vector: str, target: str, how) -> DataFrame:
    rows = cross_moments(df, vector, target).collect()
    k = _matrix(rows, "s")
    xy = np.zeros(len(k))
    for r in rows:
        if r.i == -1 and r.j >= 0:
            xy[r.j] = r.s
    return df.sparkSession.createDataFrame([(j, float(b)) for j, b in enumerate(how(k, xy))], "j int, beta double")


def ols(df: DataFrame, vector: str, target: str) -> DataFrame:
    """(j, beta) of the normal equations, without intercept; a singular matrix is an error."""
    return _solve(df, vector, target, np.linalg.solve)


def ridgeless(df: DataFrame, vector: str, target: str) -> DataFrame:
    """(j, beta): the least-norm solution. (X'X)^+ X'y is the same as X'(XX')^-1 y, but doesn't need the rows in one place."""
    return _solve(df, vector, target, lambda k, xy: np.linalg.pinv(k, hermitian=True) @ xy)


def ridge_fit(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge with an unpenalised intercept: (X'X + alpha I)^-1 X'y of centred data, in whichever space is smaller."""
    xc, yc = x - x.mean(axis=0), y - y.mean()
    if x.shape[1] <= x.shape[0]:
        return np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return xc.T @ np.linalg.solve(xc @ xc.T + alpha * np.eye(len(xc)), yc)


def ols_intercept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of least squares with an intercept, which itself is not returned."""
    return np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=None)[0]


def least_norm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x.T @ np.linalg.pinv(x @ x.T, hermitian=True) @ y


def gamma_sweep(spark, x, y, x_test, y_test, gammas, n: int = 1000, seed: int = 123) -> DataFrame:
    """(gamma, r2, mse, r2_status, mse_status): least-norm random features against the linear least-norm baseline."""
    from ridgeline.operators.random_features import phase_features

    def quality(p):
        e = ((y_test - p) ** 2).sum()
        return float(1 - e / ((y_test - y_test.mean()) ** 2).sum()), float(e / len(y_test))

    base = quality(x_test @ least_norm(x, y))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for g in f["gamma"]:
                r2, mse = quality(phase_features(x_test, n, g, seed) @ least_norm(phase_features(x, n, g, seed), y))
                rows.append((g, r2, mse))
            yield pd.DataFrame(rows, columns=["gamma", "r2", "mse"])

    found = spark.createDataFrame([(float(g),) for g in gammas], "gamma double").mapInPandas(run, "gamma double, r2 double, mse double")
    word = lambda better: F.when(better, "WINNER").otherwise("LOSE")
    return found.withColumns({"r2_status": word(F.col("r2") > base[0]), "mse_status": word(F.col("mse") < base[1])})


def density_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, n, density) of equal widths between the least and greatest value; empty bins are there too."""
    edges = df.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(column).alias("rows"))
    width = F.try_divide(F.col("b") - F.col("a"), F.lit(bins))
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("a"), width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = edges.where("rows > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("rows") * width).alias("density"),
    )
