"""Rolling ridge over whole grids of feature counts and penalties: the engine's one grouped kernel.

With A the window's features over their deviations, b the predicted row's likewise, the forecast is
b'A'(AA' + lam T I)^-1 y, which needs only T x T matrices however many features there are. AA' grows
by blocks of features along the grid, and one eigendecomposition serves all penalties, so grid and
penalties stay inside a task; series, windows, seeds and chunks of rows are the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import GAMMA, PERIOD, RunConfig
from ridgeline.operators.grids import p_grid
from ridgeline.sources.synthetic import draw_weights

SCHEMA = f"window long, seed long, t long, {PERIOD} long, y double, pi long, p long, lam double, yprd double, bnrm double"


def _solved(gram: np.ndarray, cross: np.ndarray, y: np.ndarray, penalties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and squared norms, [windows, penalties]."""
    try:
        d, u = np.linalg.eigh(gram)
        c = np.einsum("cij,ci->cj", u, y)[:, :, None] / (d[:, :, None] + penalties)
        a = u @ c
        norm = np.einsum("cj,cjl->cl", d, c * c)
    except np.linalg.LinAlgError:
        eye = np.eye(gram.shape[1])
        a = np.stack([np.linalg.solve(gram + p * eye, y[:, :, None])[:, :, 0] for p in penalties], axis=2)
        norm = np.einsum("cil,cij,cjl->cl", a, gram, a)
    return np.einsum("ci,cil->cl", cross, a), norm


def fit_rows(x: np.ndarray, y: np.ndarray, first: int, last: int, *, window: int, grid: list[int], lambdas, weights: np.ndarray, gamma: float = GAMMA, dtype: str = "float64", block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and squared norms [rows, grid, penalties] of rows first..last-1, each from the `window` rows before it."""
    halves = [p // 2 for p in grid]
    if window < 2:
        raise ValueError("window must be at least 2")
    if halves != sorted(halves):
        raise ValueError("the grid must not fall")
    if len(weights) < halves[-1]:
        raise ValueError(f"{halves[-1]} rows of weights are needed, {len(weights)} are there")
    if first < window or last > len(y):
        raise ValueError("the sample is shorter than the window")
    lo = first - window
    g = (gamma * (x[lo:last] @ weights[: halves[-1]].T)).astype(dtype)
    at = np.arange(last - first)[:, None] + np.arange(window + 1)[None, :]
    targets = y[lo:last].astype(dtype)[at[:, :window]]
    gram = np.zeros((len(at), window, window), dtype=dtype)
    cross = np.zeros((len(at), window), dtype=dtype)
    penalties = np.asarray(lambdas, dtype=dtype) * window
    out = np.empty((2, len(at), len(grid), len(penalties)))
    done = 0
    for i, half in enumerate(halves):
        if i and half == halves[i - 1]:
            out[:, :, i] = out[:, :, i - 1]
            continue
        while done < half:
            some = g[:, done : min(done + block, half)]
            z = np.hstack([np.cos(some), np.sin(some)])[at]
            scale = z[:, :window].std(axis=1, ddof=1, keepdims=True)
            if (flat := np.argwhere(scale[:, 0] == 0)).size:
                raise ValueError(f"a feature does not vary in its window (row {first + flat[0][0]}, feature {done + flat[0][1] % some.shape[1]})")
            z /= scale
            train = z[:, :window]
            gram += train @ train.transpose(0, 2, 1)
            cross += np.einsum("cij,cj->ci", train, z[:, window])
            done += some.shape[1]
        out[0, :, i], out[1, :, i] = _solved(gram, cross, targets, penalties)
    return out[0], out[1]


def _chunked(prepared: DataFrame, inputs: list[str], windows, size: int, by: tuple[str, ...]) -> DataFrame:
    """(by.., window, chunk, rows): chunks of `size` rows of a series with the window's rows before them, each a bounded array."""
    order = Window.partitionBy(*by).orderBy("t") if by else Window.orderBy("t")
    rows = prepared.withColumn("__i", F.row_number().over(order).cast("long") - 1)
    lengths = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    if lengths.where(F.col("__n") <= max(windows)).limit(1).count() or by == () and lengths.first()[0] == 0:
        raise ValueError("the sample is shorter than a window")
    w = F.explode(F.array(*(F.lit(w).cast("long") for w in windows)))
    i, first = F.col("__i"), F.greatest(F.ceil((F.col("__i") - F.col("window") - size + 1) / size), F.lit(0))
    rows = rows.withColumn("window", w).withColumn("chunk", F.explode(F.sequence(first, F.greatest(first, F.floor(i / size)).cast("long"))))
    inside = (i >= F.col("chunk") * size) & (i < F.col("chunk") * size + F.col("window") + size)
    row = F.struct("__i", "t", PERIOD, "y", F.array(*(F.col(c).cast("double") for c in inputs)).alias("x"))
    chunks = rows.where(inside).groupBy(*by, "window", "chunk").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return chunks.where(F.size("rows") > F.col("window"))


def rolling_ridge(prepared: DataFrame, inputs: list[str], cfg: RunConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., window, seed, t, yyyymm, y, pi, p, lam, yprd, bnrm) over all series, windows, seeds, grid points and penalties.

    prepared: (by.., t, yyyymm, inputs.., y); by names the columns that tell series apart (none: one series). Each chunk of
    a series travels with the rows its windows need, weights are drawn in the tasks from their seed; so neither the
    driver nor a task ever holds a series, and a lost task repeats only its own chunks. Rows must have no nulls.
    """
    spark = prepared.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in prepared.schema}
    seeds = F.broadcast(spark.createDataFrame([(s,) for s in cfg.seeds], "seed long"))
    tasks = _chunked(prepared, inputs, cfg.windows, cfg.chunk_windows, by).crossJoin(seeds)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for task in frame.to_dict("records"):
                x, y = np.array([r["x"] for r in task["rows"]]), np.array([r["y"] for r in task["rows"]])
                t, period = (np.array([r[c] for r in task["rows"]]) for c in ("t", PERIOD))
                grid = p_grid(task["window"], cfg.max_p)
                weights = draw_weights(task["seed"], x.shape[1], grid[-1] // 2)
                yprd, bnrm = fit_rows(x, y, task["window"], len(y), window=task["window"], grid=grid, lambdas=cfg.lambdas, weights=weights, gamma=cfg.gamma, dtype=cfg.dtype, block=cfg.chunk_half_features)
                k, n_p, n_l = yprd.shape
                each = np.repeat(np.arange(task["window"], len(y)), n_p * n_l)
                yield pd.DataFrame({c: task[c] for c in by} | {
                    "window": task["window"], "seed": task["seed"], "t": t[each], PERIOD: period[each], "y": y[each],
                    "pi": np.tile(np.repeat(np.arange(n_p), n_l), k), "p": np.tile(np.repeat(grid, n_l), k), "lam": np.tile(cfg.lambdas, k * n_p),
                    "yprd": yprd.ravel(), "bnrm": bnrm.ravel(),
                })

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), SCHEMA])
    # Chunks and seeds are heavy rows: they are dealt out evenly, so that few wait behind another.
    return tasks.repartition(F.col("window"), F.col("seed"), F.col("chunk"), *(F.col(c) for c in by)).mapInPandas(run, schema)
