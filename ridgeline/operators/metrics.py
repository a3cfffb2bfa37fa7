"""Forecast metrics as SQL aggregates: first for each seed, then across seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import METRICS, PERCENTILES, PERIOD
from ridgeline.functions.numeric import ieee_div, not_nan
from ridgeline.operators.predictors import ordered


def with_subsamples(predictions: DataFrame, subsamples: DataFrame) -> DataFrame:
    """Each row once for every subsample whose inclusive bounds hold its period (null: no bound); a handful of rows, broadcast."""
    s = F.broadcast(subsamples)
    inside = (F.coalesce(predictions[PERIOD] >= s["lo"], F.lit(True))) & (F.coalesce(predictions[PERIOD] <= s["hi"], F.lit(True)))
    return predictions.join(s, inside).drop("lo", "hi")


def seed_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """r2, er, vol, sr, alpha, alpha_t, ir (and bnrm, if there) of each group of (y, yprd)."""
    y, f = F.col("y"), F.col("yprd")
    has_norm = "bnrm" in predictions.columns
    rows = predictions.withColumn("__m", f * y)
    moments = rows.groupBy(*keys).agg(
        F.var_samp(f - y).alias("__ve"), F.var_samp(y).alias("__vy"), F.avg("__m").alias("er"), F.stddev_samp("__m").alias("vol"),
        F.regr_intercept("__m", y).alias("alpha"), F.regr_sxx("__m", y).alias("__sxx"), F.regr_sxy("__m", y).alias("__sxy"), F.regr_syy("__m", y).alias("__syy"),
        F.count(y).alias("__n"), F.avg(y).alias("__my"), *([F.avg("bnrm").alias("bnrm")] if has_norm else []),
    )
    rss = F.greatest(F.col("__syy") - F.try_divide(F.col("__sxy") * F.col("__sxy"), F.col("__sxx")), F.lit(0.0))
    n = F.col("__n")
    error = F.sqrt(F.try_divide(F.col("__rss"), n - 2) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.col("__my") * F.col("__my"), F.col("__sxx"))))
    return moments.withColumn("__rss", rss).select(
        *keys, (F.lit(1.0) - ieee_div(F.col("__ve"), F.col("__vy"))).alias("r2"), "er", "vol", ieee_div(F.col("er"), F.col("vol")).alias("sr"),
        "alpha", ieee_div(F.col("alpha"), error).alias("alpha_t"), ieee_div(F.col("alpha"), F.sqrt(F.try_divide(F.col("__rss"), n - 1))).alias("ir"), *(["bnrm"] if has_norm else []),
    )


def percentile_name(q: float) -> str:
    return f"p{q}".replace(".", "_")


def across_seeds(per_seed: DataFrame, keys: list[str], percentiles=PERCENTILES) -> DataFrame:
    """keys, n_seeds, then of every metric its mean and exact percentiles over seeds, NaN left out."""
    names = [m for m in METRICS if m in per_seed.columns]
    shares = F.array(*(F.lit(q / 100) for q in percentiles))
    grouped = per_seed.groupBy(*keys).agg(F.count("*").alias("n_seeds"), *(x for m in names for x in (F.avg(not_nan(F.col(m))).alias(f"{m}_mean"), F.percentile(not_nan(F.col(m)), shares).alias(f"__{m}"))))
    return grouped.select(*keys, "n_seeds", *(x for m in names for x in (F.col(f"{m}_mean"), *(F.col(f"__{m}")[i].alias(f"{m}_{percentile_name(q)}") for i, q in enumerate(percentiles)))))


def classic(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean squared error, and 1 - SSres/SStot, which a bias lowers."""
    e = F.col("y") - F.col("yprd")
    return predictions.groupBy(*keys).agg(F.avg(e * e).alias("mse"), (F.lit(1.0) - ieee_div(F.sum(e * e), F.regr_syy("y", "y"))).alias("r2_classic"))


def out_of_sample_r2(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """1 - squared errors over those of the mean of all y before (published formula); each key's first row has no mean and leaves."""
    w = Window.partitionBy(*keys).orderBy(PERIOD).rowsBetween(Window.unboundedPreceding, -1) if keys else ordered().rowsBetween(Window.unboundedPreceding, -1)
    rows = predictions.withColumn("__mean", F.avg("y").over(w)).where("__mean IS NOT NULL")
    return rows.groupBy(*keys).agg((F.lit(1.0) - ieee_div(F.sum(F.pow(F.col("y") - F.col("yprd"), 2)), F.sum(F.pow(F.col("y") - F.col("__mean"), 2)))).alias("r2_oos"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max, a row for each column."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(c).cast("double").alias("max"))
        for c in columns
    ]
    return df.agg(F.array(*cells).alias("a")).select(F.inline("a")).select("column", "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")
