"""Grids of feature counts and the sweep's dimensions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.config import MAX_P, SUBSAMPLES


# The published grid's regions for a window w, as (first, last, step), each a * w + b with the pair (a, b).
REGIONS = (((0, 2), (0, 2), (0, 1)), ((0, 5), (1, -5), (0.1, 0)), ((1, -4), (1, 4), (0, 2)), ((1, 5), (30, 0), (0.5, 0)), ((31, 0), (np.inf, 0), (10, 0)))
LEAST_WINDOW = 10


def _checked(window: int) -> int:
    if window < LEAST_WINDOW:
        raise ValueError(f"the grid is defined for windows of {LEAST_WINDOW} and more, not {window}")
    return window


def p_grid(window: int, max_p: int = MAX_P) -> list[int]:
    """Total feature counts: sparse, dense about the window's length, and sparse again; repeats stay, and max_p is last."""
    ends = np.array(REGIONS)[:, :, 0] * _checked(window) + np.array(REGIONS)[:, :, 1]
    counts = np.concatenate([np.arange(first, min(last, max_p) + 0.5, np.floor(step)) for first, last, step in ends])
    return [*counts[counts < max_p].astype(int).tolist(), max_p]


def feature_count(p: int) -> int:
    """cos and sin come in pairs: an odd count loses one."""
    return p - p % 2


def multiples(window: int, most: int) -> list[int]:
    """The older generation's grid: multiples of the window."""
    if window <= 0:
        raise ValueError("window must be positive")
    return [window * (k + 1) for k in range(most // window)]


def grid_frame(spark: SparkSession, windows: tuple[int, ...], max_p: int = MAX_P) -> DataFrame:
    """(window, pi, p, half), built by Spark from each region's sequence; pi numbers a window's grid from 0."""
    w = spark.createDataFrame([(_checked(x),) for x in windows], "window long")
    at = lambda a, b: F.least(F.floor(F.lit(float(a)) * F.col("window")) + b, F.lit(max_p)).cast("long") if np.isfinite(a) else F.lit(max_p).cast("long")
    region = lambda first, last, step: F.when(at(*first) <= at(*last), F.sequence(at(*first), at(*last), F.greatest(at(*step), F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    grid = F.concat(F.filter(F.concat(*(region(*r) for r in REGIONS)), lambda p: p < max_p), F.array(F.lit(max_p).cast("long")))
    return w.select("window", F.posexplode(grid).alias("pi", "p")).select("window", F.col("pi").cast("long").alias("pi"), "p", F.floor(F.col("p") / 2).alias("half"))


def subsample_frame(spark: SparkSession, subsamples=SUBSAMPLES) -> DataFrame:
    """(subsample, lo, hi): 'full' without bounds, then inclusive years as periods."""
    rows = [("full", None, None)] + [(f"{a}-{b}", a * 100 + 1, b * 100 + 12) for a, b in subsamples]
    return spark.createDataFrame(rows, "subsample string, lo long, hi long")


def sweep(spark: SparkSession, windows, seeds, max_p, lambdas) -> DataFrame:
    """(window, seed, pi, p, lam): all combinations; small tables of parameters, whose product is the size of the result."""
    seeds_ = spark.createDataFrame([(s,) for s in seeds], "seed long")
    lams = spark.createDataFrame([(float(x),) for x in lambdas], "lam double")
    return grid_frame(spark, windows, max_p).drop("half").crossJoin(F.broadcast(seeds_)).crossJoin(F.broadcast(lams)).select("window", "seed", "pi", "p", "lam")


def windows_of_features(spark: SparkSession, windows, most: int) -> DataFrame:
    """(n_features, windows): for each count of the older grid, the windows that use it."""
    w = spark.createDataFrame([(x,) for x in windows], "window long")
    rows = w.select("window", F.explode(F.sequence(F.col("window"), F.greatest(F.lit(most), F.col("window")).cast("long"), F.col("window"))).alias("n_features")).where(F.col("n_features") <= most)
    return rows.groupBy("n_features").agg(F.sort_array(F.collect_list("window")).alias("windows"))
