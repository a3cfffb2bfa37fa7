"""Reports on aggregated metrics: plot series, acceptance bands, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Panels (metric, factor). Sharpe ratios are annualised only here.
PANELS = (("r2_mean", 1.0), ("sr_mean", 12.0**0.5), ("bnrm_mean", 1.0), ("alpha_t_mean", 1.0))


def plot_series(metrics: DataFrame, subsample: str = "full") -> DataFrame:
    """(panel, window, lam, c, value), one line for each penalty; panels whose column is absent are left out."""
    there = [(m, k) for m, k in PANELS if m in metrics.columns]
    cells = F.array(*(F.struct(F.lit(m.removesuffix("_mean")).alias("panel"), (F.col(m) * k).alias("value")) for m, k in there))
    rows = metrics.where(F.col("subsample") == subsample).select("window", "lam", (F.col("p") / F.col("window")).alias("c"), F.explode(cells).alias("x"))
    return rows.select("x.panel", "window", "lam", "c", "x.value")


def acceptance_bands(metrics: DataFrame, lam: float = 0.001, subsample: str = "full") -> DataFrame:
    """For each window: R2 about c = 1 and in the tail, annualised Sharpe by band, and the norm's spike over its tail."""
    c = F.col("p") / F.col("window")
    near, tail, head = (c > 0.5) & (c < 2.0), c > 50, c <= 0.5
    of = lambda cond, m: F.when(cond, F.col(m))
    out = [
        F.min(of(near, "r2_mean")).alias("r2_dip"),
        F.avg(of(tail, "r2_mean")).alias("r2_tail"),
        (F.avg(of(head, "sr_mean")) * F.sqrt(F.lit(12.0))).alias("sr_head"),
        (F.min(of(near, "sr_mean")) * F.sqrt(F.lit(12.0))).alias("sr_near"),
        (F.avg(of(tail, "sr_mean")) * F.sqrt(F.lit(12.0))).alias("sr_tail"),
    ]
    if "bnrm_mean" in metrics.columns:
        out.append((F.max(of(near, "bnrm_mean")) / F.greatest(F.avg(of(tail, "bnrm_mean")), F.lit(1e-12))).alias("bnrm_spike"))
    return metrics.where((F.col("subsample") == subsample) & (F.col("lam") == lam)).groupBy("window").agg(*out)


def ranked(metrics: DataFrame, metric: str, n: int = 10, best: bool = True) -> DataFrame:
    """The n best (or worst) configurations; ties go to the smaller (window, p, lam)."""
    order = F.desc_nulls_last(metric) if best else F.asc_nulls_last(metric)
    return metrics.orderBy(order, "window", "p", "lam").limit(n)
