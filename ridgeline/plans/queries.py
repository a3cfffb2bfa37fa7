"""The registered queries of the forecasting operators, on the star schema's tables, with their SQL."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.config import LAMBDAS, PERCENTILES, PREDICTORS, RunConfig
from ridgeline.functions.numeric import r6
from ridgeline.operators import grids, linear, metrics, predictors, random_features, ridge, ridge_sql, scaling
from ridgeline.operators.predictors import INPUTS
from ridgeline.plans import report
from ridgeline.plans.run import metrics_of
from ridgeline.sources import tables
from ridgeline.sources.synthetic import draw_weights, regression_sample, sparse_beta

SEEDS, T, LAM = (1, 2, 3, 4, 5), 12, 0.1
_WEIGHTS = {s: [float(x) for x in draw_weights(s, len(INPUTS), 1)[0]] for s in SEEDS}
#: Subsamples of the panel's years, as the tables' calendar is its own.
YEARS = ((1995, 2001), (1995, 1999), (2000, 2001))


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(r6(F.col(f"`{c}`")).alias(c) if kinds[c] == "double" and c not in keep else F.col(f"`{c}`") for c in df.columns))


def monthly(spark, sf):
    return tables.period_panel(_t(spark, sf, "orders"), _t(spark, sf, "lineitem"))


def weekly(spark, sf):
    return tables.period_panel(_t(spark, sf, "orders"), _t(spark, sf, "lineitem"), tables.week_of)


def predictions_p2(spark, sf, seeds=SEEDS, lambdas=(LAM,)) -> DataFrame:
    """(seed, lam, t, yyyymm, y, yprd, bnrm) of two features a seed, all in one pass of window functions over (seed)."""
    w = spark.createDataFrame([(s, _WEIGHTS[s]) for s in seeds], "seed long, w array<double>")
    g = reduce(lambda a, b: a + b, (F.col(c) * F.col("w")[i] for i, c in enumerate(INPUTS))) * 2.0
    z = scaling.prepare(monthly(spark, sf)).crossJoin(F.broadcast(w)).select("seed", "t", "yyyymm", "y", F.cos(g).alias("z1"), F.sin(g).alias("z2"))
    return ridge_sql.rolling_ridge(z, T, tuple(lambdas), by=("seed",))


def per_seed(spark, sf, lambdas=(LAM,)) -> DataFrame:
    rows = metrics.with_subsamples(predictions_p2(spark, sf, lambdas=lambdas), grids.subsample_frame(spark, YEARS))
    return metrics.seed_metrics(rows, ["subsample", "seed", "lam"])


def q_panel_weekly(spark, sf):
    """The nudge keeps averages, of which few rows make one, from lying halfway between two roundings."""
    df = weekly(spark, sf)
    return rounded(df.select("yyyymm", *((F.col(f"`{c}`") + 1e-8).alias(c) for c in df.columns[1:])))


def q_lagged_xy(spark, sf):
    return rounded(predictors.lagged_xy(monthly(spark, sf)))


def q_inner_join_panel(spark, sf):
    left = predictors.build_predictors(monthly(spark, sf)).select("yyyymm", "dp", "tms")
    factors = _t(spark, sf, "events").groupBy(tables.month_of("ts").alias("yyyymm")).agg(F.avg("value").alias("factor"))
    shifted = factors.select((F.col("yyyymm") % 100 + 199900).alias("yyyymm"), "factor")
    return rounded(predictors.with_factors(left, shifted))


def q_euro_csv_parse(spark, sf):
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return _t(spark, sf, "orders").select("o_orderkey", r6(tables.euro_number(text)).alias("price"))


def q_scale(how):
    def query(spark, sf):
        df = monthly(spark, sf).select("yyyymm", "Index", "tbl", F.col("ltr"))
        return rounded(how(df))

    return query


def q_rff_projection(spark, sf):
    w = draw_weights(1, len(INPUTS), 2)
    x = scaling.prepare(monthly(spark, sf))
    return rounded(x.select("t", "yyyymm", *random_features.projection(list(INPUTS), w)))


def q_rff_features(spark, sf):
    x = scaling.prepare(monthly(spark, sf)).select("t", "yyyymm", *INPUTS)
    return rounded(random_features.features(x, list(INPUTS), draw_weights(1, len(INPUTS), 2)))


def q_ridge_p2(spark, sf):
    return rounded(predictions_p2(spark, sf, (1,)).select("yyyymm", "y", "yprd"))


def q_beta_norm_p2(spark, sf):
    return rounded(predictions_p2(spark, sf, (1,)).select("yyyymm", "bnrm"))


def q_ridge_kernel_p2(spark, sf):
    cfg = RunConfig(windows=(T,), n_seeds=2, max_p=2)
    found = ridge.rolling_ridge(scaling.prepare(monthly(spark, sf)), list(INPUTS), cfg)
    return rounded(found.select("seed", "yyyymm", "lam", "yprd", "bnrm"), keep=("lam",))


def q_ridge_small_p(spark, sf):
    x = scaling.prepare(weekly(spark, sf)).select("t", "yyyymm", *INPUTS, "y")
    z = random_features.features(x, list(INPUTS), draw_weights(1, len(INPUTS), 3))
    return rounded(ridge_sql.rolling_ridge(z, T, LAM))


def grid_predictions(spark, sf, n_seeds=2, max_p=24, windows=(T,)):
    cfg = RunConfig(windows=windows, n_seeds=n_seeds, max_p=max_p, subsamples=YEARS)
    return ridge.rolling_ridge(scaling.prepare(monthly(spark, sf)), list(INPUTS), cfg), cfg


def q_ridge_grid_udf(spark, sf):
    return rounded(grid_predictions(spark, sf)[0], keep=("lam",))


def q_ridge_kernel_weekly(spark, sf):
    """The kernel's longer windows, on the weekly panel."""
    cfg = RunConfig(windows=(60, 120), n_seeds=1, max_p=4)
    found = ridge.rolling_ridge(scaling.prepare(weekly(spark, sf)), list(INPUTS), cfg)
    return rounded(found.select("window", "yyyymm", "p", "lam", "yprd", "bnrm"), keep=("lam",))


def q_run_metrics_small(spark, sf):
    return rounded(metrics_of(*grid_predictions(spark, sf, max_p=4)).drop("window"), keep=("lam",))


def q_run_metrics(spark, sf):
    return rounded(metrics_of(*grid_predictions(spark, sf)), keep=("lam",))


def q_timing_moments(spark, sf):
    return rounded(per_seed(spark, sf).select("subsample", "seed", "er", "vol", "sr"))


def q_oos_r2(spark, sf):
    return rounded(per_seed(spark, sf).select("subsample", "seed", "r2"))


def q_ols_alpha(spark, sf):
    return rounded(per_seed(spark, sf).select("subsample", "seed", "alpha", "alpha_t", "ir"))


def q_subsample_metrics(spark, sf):
    rows = metrics.with_subsamples(predictions_p2(spark, sf, (1,)), grids.subsample_frame(spark, YEARS))
    return rounded(rows.groupBy("subsample").agg(F.count("*").alias("n"), F.min("yyyymm").alias("first"), F.max("yyyymm").alias("last"), F.avg("bnrm").alias("bnrm")))


def q_seed_percentiles(spark, sf):
    return rounded(metrics.across_seeds(per_seed(spark, sf), ["subsample", "lam"]).drop("lam"))


def q_mse_r2_classic(spark, sf):
    return rounded(metrics.classic(predictions_p2(spark, sf), ["seed"]))


def q_ct_oos_r2(spark, sf):
    return rounded(metrics.out_of_sample_r2(predictions_p2(spark, sf), ["seed"]))


def q_union_subsamples(spark, sf):
    one = predictions_p2(spark, sf, (1,)).select("yyyymm", "yprd")
    parts = [one.where(F.col("yyyymm").between(a * 100 + 1, b * 100 + 12)).withColumn("subsample", F.lit(f"{a}-{b}")) for a, b in YEARS]
    return rounded(reduce(DataFrame.unionByName, [one.withColumn("subsample", F.lit("full")), *parts]))


def q_topk_configs(spark, sf):
    found = metrics.across_seeds(per_seed(spark, sf, LAMBDAS), ["subsample", "lam"]).where("subsample = 'full'")
    shaped = found.select(F.lit(T).cast("long").alias("window"), F.lit(2).cast("long").alias("p"), "lam", "sr_mean")
    best = report.ranked(shaped, "sr_mean", 3).withColumn("side", F.lit("best"))
    worst = report.ranked(shaped, "sr_mean", 3, best=False).withColumn("side", F.lit("worst"))
    return rounded(best.unionByName(worst), keep=("lam",))


def made_metrics(spark) -> DataFrame:
    """A frame in the metrics' schema over the whole grids, of made-up smooth values, for the reports."""
    g = grids.sweep(spark, (12, 60, 120), (1,), 12_000, (0.001, 1.0))
    c = F.col("p") / F.col("window")
    near = F.lit(1.0) / (F.lit(0.05) + F.abs(c - 1))
    return g.select(
        "window", F.lit("full").alias("subsample"), "p", "lam", (F.lit(0.01) - near * F.sqrt("lam")).alias("r2_mean"), (F.ln(c + 1) / 10 - near / 100).alias("sr_mean"), (near + 0.001 * F.col("lam")).alias("bnrm_mean")
    )


def q_plot_series(spark, sf):
    return rounded(report.plot_series(made_metrics(spark)), keep=("lam",))


def q_acceptance_bands(spark, sf):
    return rounded(report.acceptance_bands(made_metrics(spark)))


def q_windows_of_features(spark, sf):
    return grids.windows_of_features(spark, (12, 60, 120), 1200).select("n_features", F.array_join(F.col("windows").cast("array<string>"), ",").alias("windows"))


def q_describe(spark, sf):
    return rounded(metrics.describe(_t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


def q_index_range(spark, sf):
    return monthly(spark, sf).agg(F.min("yyyymm").alias("first"), F.max("yyyymm").alias("last"), F.count("*").alias("n"))


def q_median(spark, sf):
    return rounded(_t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("median_price")))


def q_covariance(spark, sf):
    return rounded(linear.covariance(_t(spark, sf, "embeddings"), "embedding"))


def q_histogram(spark, sf):
    return linear.density_histogram(_t(spark, sf, "orders"), "o_totalprice", 50).select("bin", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n", r6(F.col("density") * 1e6).alias("density_millionth"))


def q_spectrum(spark, sf):
    return rounded(linear.spectrum(_t(spark, sf, "embeddings"), "embedding"))


def _labelled(spark, sf):
    return _t(spark, sf, "embeddings").select("embedding", F.col("label").cast("double").alias("label"))


def q_ols(spark, sf):
    return rounded(linear.ols(_labelled(spark, sf), "embedding", "label"))


def q_ridgeless(spark, sf):
    return rounded(linear.ridgeless(_labelled(spark, sf), "embedding", "label"))


def q_gamma_sweep(spark, sf):
    beta = sparse_beta(120, 8, stream=7)
    (x, y), (x_test, y_test) = (regression_sample(rows, beta, noise=0.2, stream=k, curved=True) for k, rows in ((7, 60), (8, 90)))
    return rounded(linear.gamma_sweep(spark, x, y, x_test, y_test, (0.02, 0.1, 0.3, 1.0, 3.0, 9.0), n=1000), keep=("gamma",))


def q_sweep_cross(spark, sf):
    return grids.sweep(spark, (12, 60, 120), SEEDS, 240, LAMBDAS)


QUERIES = {
    "panel_monthly": lambda s, d: rounded(monthly(s, d)),
    "panel_weekly": q_panel_weekly,
    "predictors_gw": lambda s, d: rounded(predictors.build_predictors(monthly(s, d))),
    "excess_return": lambda s, d: rounded(predictors.excess_return(monthly(s, d))),
    "lagged_xy": q_lagged_xy,
    "inner_join_panel": q_inner_join_panel,
    "euro_csv_parse": q_euro_csv_parse,
    "expanding_std_scale": q_scale(lambda d: scaling.expanding_std(d, ["Index", "tbl"]).drop("ltr")),
    "trailing_rms_scale": q_scale(lambda d: scaling.trailing_rms(d.where("ltr IS NOT NULL"), "ltr").select("yyyymm", "ltr")),
    "expanding_zscore": q_scale(lambda d: scaling.expanding_zscore(d, ["Index", "tbl"]).drop("ltr")),
    "rolling_zscore": q_scale(lambda d: scaling.rolling_zscore(d, "Index").select("yyyymm", "Index")),
    "prefix_sums": q_scale(lambda d: scaling.prefix_sums(d, "tbl")),
    "prepared_dataset": lambda s, d: rounded(scaling.prepare(monthly(s, d))),
    "p_grid": lambda s, d: grids.grid_frame(s, (12, 60, 120)).drop("half"),
    "feature_counts": lambda s, d: grids.grid_frame(s, (12,), 100).select("p", (F.col("half") * 2).alias("features")),
    "multiples_grid": lambda s, d: s.range(1).select(F.explode(F.array(*(F.lit(x).cast("long") for x in grids.multiples(60, 12_000)))).alias("p")),
    "windows_of_features": q_windows_of_features,
    "sweep_cross": q_sweep_cross,
    "rff_projection": q_rff_projection,
    "rff_features": q_rff_features,
    "ridge_p2": q_ridge_p2,
    "beta_norm_p2": q_beta_norm_p2,
    "ridge_kernel_p2": q_ridge_kernel_p2,
    "ridge_small_p": q_ridge_small_p,
    "ridge_grid_udf": q_ridge_grid_udf,
    "ridge_kernel_weekly": q_ridge_kernel_weekly,
    "run_metrics_small": q_run_metrics_small,
    "run_metrics": q_run_metrics,
    "timing_moments": q_timing_moments,
    "oos_r2": q_oos_r2,
    "ols_alpha": q_ols_alpha,
    "subsample_metrics": q_subsample_metrics,
    "seed_percentiles": q_seed_percentiles,
    "mse_r2_classic": q_mse_r2_classic,
    "ct_oos_r2": q_ct_oos_r2,
    "union_subsamples": q_union_subsamples,
    "topk_configs": q_topk_configs,
    "plot_series": q_plot_series,
    "acceptance_bands": q_acceptance_bands,
    "describe_exact": q_describe,
    "index_range": q_index_range,
    "median_agg": q_median,
    "covariance_gram": q_covariance,
    "density_histogram": q_histogram,
    "eigen_spectrum": q_spectrum,
    "ols_normal": q_ols,
    "ridgeless": q_ridgeless,
    "gamma_sweep": q_gamma_sweep,
}


def entry(spark: SparkSession) -> DataFrame:
    """Forecasts of two random features on the monthly panel, with their metrics by subsample."""
    rows = metrics.with_subsamples(predictions_p2(spark, "/root/testdata/sf0.001", (1,)), grids.subsample_frame(spark, YEARS))
    return rounded(metrics.seed_metrics(rows, ["subsample", "seed"]))


# --- SQL, written by hand for DuckDB -----------------------------------------------------------


def _panel(period: str) -> str:
    o, s = period.format("o_orderdate"), period.format("l_shipdate")
    return f"""
    o AS (SELECT {o} AS m, avg(o_totalprice) AS idx, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1),
    l AS (
        SELECT {s} AS m, avg(l_extendedprice * l_discount) AS d12, avg(l_extendedprice) AS e12, avg(l_tax) AS tbl, avg(l_discount) AS lty,
               avg(l_discount) FILTER (WHERE l_returnflag = 'R') AS baa, avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS aaa,
               avg(l_quantity) AS qty, var_samp(l_discount) AS svar
        FROM lineitem GROUP BY 1
    ),
    raw AS (
        SELECT o.m AS yyyymm, idx AS "Index", d12 AS "D12", e12 AS "E12", qty / 50 AS "b/m", tbl, aaa AS "AAA", baa AS "BAA", lty,
               n / lag(n) OVER w - 1 AS ntis, tbl / 12 AS "Rfree", e12 / lag(e12) OVER w - 1 AS infl, qty / lag(qty) OVER w - 1 AS ltr,
               lty / lag(lty) OVER w - 1 AS corpr, svar, idx / lag(idx) OVER w - 1 AS "CRSP_SPvw"
        FROM o JOIN l ON o.m = l.m
        WINDOW w AS (ORDER BY o.m)
    )"""


MONTH = "CAST(year({0}) * 100 + month({0}) AS BIGINT)"
WEEK = "CAST(floor(datediff('day', DATE '1995-01-02', CAST({0} AS DATE)) / 7) AS BIGINT)"
RAW = _panel(MONTH)
GW = """
    gw AS (
        SELECT yyyymm, "BAA" - "AAA" AS dfy, infl, svar, ln("D12") - ln("E12") AS de, lty, lty - tbl AS tms, tbl, corpr - ltr AS dfr,
               ln("D12") - ln("Index") AS dp, ln("D12") - lag(ln("Index")) OVER (ORDER BY yyyymm) AS dy, ltr, ln("E12") - ln("Index") AS ep,
               "b/m" AS bm, ntis, "CRSP_SPvw" - "Rfree" AS y
        FROM raw
    )"""
XY = (
    "xy AS (SELECT * FROM (SELECT yyyymm, "
    + ", ".join(f"lag({c}) OVER w AS {c}" for c in PREDICTORS)
    + ", lag(y) OVER w AS lag_mkt, y FROM gw WINDOW w AS (ORDER BY yyyymm)) WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in (*INPUTS, "y"))
    + ")"
)
PREP = (
    "sc AS (SELECT row_number() OVER (ORDER BY yyyymm) - 36 AS t, yyyymm, "
    + ", ".join(f"{c} / stddev_samp({c}) OVER u AS {c}" for c in INPUTS)
    + ", y / sqrt(avg(y * y) OVER (ORDER BY yyyymm ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) AS y"
    + " FROM xy WINDOW u AS (ORDER BY yyyymm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), prep AS (SELECT * FROM sc WHERE t > 0)"
)
BASE = f"WITH {RAW}, {GW}, {XY}, {PREP}"


def _r(*names: str) -> str:
    return ", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in names)


def _num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _weights(seeds) -> str:
    rows = ", ".join("(CAST({} AS BIGINT), {})".format(s, ", ".join(map(_num, _WEIGHTS[s]))) for s in seeds)
    return f"w(seed, {', '.join(f'w{i}' for i in range(len(INPUTS)))}) AS (VALUES {rows})"


def _lams(values) -> str:
    return "lams(lam) AS (VALUES " + ", ".join(f"({_num(x)})" for x in values) + ")"


def _p2(seeds=SEEDS, lambdas=(LAM,)) -> str:
    """Closed form of two features: windowed moments, Cramer's rule."""
    g = " + ".join(f"{c} * w{i}" for i, c in enumerate(INPUTS))
    return f"""{BASE}, {_weights(seeds)}, {_lams(lambdas)},
    g AS (SELECT seed, t, yyyymm, y, 2 * ({g}) AS g FROM prep, w),
    z AS (SELECT seed, t, yyyymm, y, cos(g) AS a, sin(g) AS b FROM g),
    m AS (
        SELECT *, count(*) OVER f AS n, stddev_samp(a) OVER f AS sa, stddev_samp(b) OVER f AS sb, sum(a * a) OVER f AS aa, sum(a * b) OVER f AS ab,
               sum(b * b) OVER f AS bb, sum(a * y) OVER f AS ay, sum(b * y) OVER f AS byy
        FROM z WINDOW f AS (PARTITION BY seed ORDER BY t ROWS BETWEEN {T} PRECEDING AND 1 PRECEDING)
    ),
    k AS (
        SELECT seed, lam, t, yyyymm, y, a / sa AS a, b / sb AS b, aa / (sa * sa) + lam * {T} AS aa, ab / (sa * sb) AS ab, bb / (sb * sb) + lam * {T} AS bb, ay / sa AS ay, byy / sb AS byy
        FROM m, lams WHERE n = {T}
    ),
    beta AS (SELECT *, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS b1, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS b2 FROM k),
    pred AS (SELECT seed, lam, t, yyyymm, y, b1 * a + b2 * b AS yprd, b1 * b1 + b2 * b2 AS bnrm FROM beta)"""


def _base(period: str) -> str:
    return f"WITH {_panel(period)}, {GW}, {XY}, {PREP}"


def _solved(name: str, half: int, seeds, lambdas, window: int) -> str:
    """CTEs from prep to `name` (seed, lam, t, yyyymm, y, yprd, bnrm): windowed moments of 2 * half features, then elimination pivot by pivot."""
    n = 2 * half
    g = " UNION ALL ".join(
        f"SELECT CAST({s} AS BIGINT) AS seed, t, yyyymm, y, " + ", ".join(f"2 * ({' + '.join(f'{c} * {_num(float(x))}' for c, x in zip(INPUTS, row, strict=True))}) AS g{j}" for j, row in enumerate(draw_weights(s, len(INPUTS), half))) + " FROM prep"
        for s in seeds
    )
    pairs, own = [(i, j) for i in range(n) for j in range(i, n)], "seed, lam, t, yyyymm, y"
    z = ", ".join(f"{'cos' if i < half else 'sin'}(g{i % half}) AS z{i}" for i in range(n))
    moments = ", ".join([f"stddev_samp(z{i}) OVER f AS s{i}, sum(z{i} * y) OVER f AS r{i}" for i in range(n)] + [f"sum(z{i} * z{j}) OVER f AS k{i}_{j}" for i, j in pairs])
    scaled = ", ".join([f"z{i} / s{i} AS z{i}, r{i} / s{i} AS r{i}" for i in range(n)] + [f"k{i}_{j} / (s{i} * s{j})" + (f" + lam * {window}" if i == j else "") + f" AS k{i}_{j}" for i, j in pairs])
    out = [f"{name}g AS ({g})", f"{name}z AS (SELECT seed, t, yyyymm, y, {z} FROM {name}g)", _lams(lambdas).replace("lams", f"{name}l", 1)]
    out.append(f"{name}m AS (SELECT *, count(*) OVER f AS n, {moments} FROM {name}z WINDOW f AS (PARTITION BY seed ORDER BY t ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING))")
    out.append(f"{name}e0 AS (SELECT {own}, {scaled} FROM {name}m, {name}l WHERE n = {window})")
    for p in range(n - 1):
        new = [f"k{i}_{j} - k{p}_{i} / k{p}_{p} * k{p}_{j} AS k{i}_{j}" for i, j in pairs if i > p] + [f"r{i} - k{p}_{i} / k{p}_{p} * r{p} AS r{i}" for i in range(p + 1, n)]
        out.append(f"{name}e{p + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM {name}e{p})")
    at = f"{name}e{n - 1}"
    for i in reversed(range(n)):
        rest = "".join(f" - k{i}_{j} * b{j}" for j in range(i + 1, n))
        out.append(f"{name}b{i} AS (SELECT *, (r{i}{rest}) / k{i}_{i} AS b{i} FROM {at})")
        at = f"{name}b{i}"
    out.append(f"{name} AS (SELECT {own}, {' + '.join(f'b{i} * z{i}' for i in range(n))} AS yprd, {' + '.join(f'b{i} * b{i}' for i in range(n))} AS bnrm FROM {at})")
    return ", ".join(out)


def _subs() -> str:
    rows = ["('full', NULL, NULL)"] + [f"('{a}-{b}', {a}01, {b}12)" for a, b in YEARS]
    return "subs(subsample, lo, hi) AS (VALUES " + ", ".join(rows) + ")"


def _per_seed(lambdas=(LAM,)) -> str:
    return f"{_p2(SEEDS, lambdas)}, {_metrics('seed, lam')}"


def _metrics(keys: str) -> str:
    """CTEs from pred (keys, yyyymm, y, yprd, bnrm) to the metrics of each subsample and seed."""
    return f"""{_subs()},
    s AS (SELECT subs.subsample, pred.*, yprd * y AS tm FROM pred JOIN subs ON (lo IS NULL OR yyyymm >= lo) AND (hi IS NULL OR yyyymm <= hi)),
    c AS (
        SELECT subsample, {keys}, count(*) AS n, 1 - var_samp(yprd - y) / var_samp(y) AS r2, avg(tm) AS er, stddev_samp(tm) AS vol, avg(y) AS my,
               covar_pop(tm, y) / var_pop(y) AS slope, var_pop(y) * count(*) AS sxx, var_pop(tm) * count(*) AS syy, covar_pop(tm, y) * count(*) AS sxy, avg(bnrm) AS bnrm
        FROM s GROUP BY ALL
    ),
    e AS (SELECT *, er / vol AS sr, er - slope * my AS alpha, syy - sxy * sxy / sxx AS rss FROM c),
    seeds AS (SELECT subsample, {keys}, r2, er, vol, sr, alpha, alpha / sqrt(rss / (n - 2) * (1.0 / n + my * my / sxx)) AS alpha_t, alpha / sqrt(rss / (n - 1)) AS ir, bnrm FROM e)"""


def _across() -> str:
    cells = []
    for m in ("r2", "er", "vol", "sr", "alpha", "alpha_t", "ir", "bnrm"):
        cells.append(f"round(avg({m}), 6) + 0.0 AS {m}_mean")
        cells += [f"round(quantile_cont({m}, {q / 100}), 6) + 0.0 AS {m}_p{str(q).replace('.', '_')}" for q in PERCENTILES]
    return ", ".join(cells)


GRID = """
    win(w) AS (VALUES (12), (60), (120)),
    parts AS (
        SELECT w, 1 AS part, 2 AS p FROM win
        UNION ALL SELECT w, 2, unnest(range(5, w - 4, w // 10)) FROM win
        UNION ALL SELECT w, 3, unnest(range(w - 4, w + 5, 2)) FROM win
        UNION ALL SELECT w, 4, unnest(range(w + 5, 30 * w + 1, w // 2)) FROM win
        UNION ALL SELECT w, 5, unnest(range(31 * w, {0}, 10 * w)) FROM win
    ),
    grid AS (SELECT w, part, p FROM parts WHERE p < {0} UNION ALL SELECT w, 6, {0} FROM win)"""
MADE = f"""WITH {GRID.format(12000)},
    made AS (
        SELECT w, p, lam, CAST(p AS DOUBLE) / w AS c, 1.0 / (CAST('0.05' AS DOUBLE) + abs(CAST(p AS DOUBLE) / w - 1)) AS near
        FROM grid, (VALUES (CAST('0.001' AS DOUBLE)), (CAST('1.0' AS DOUBLE))) AS x(lam)
    ),
    met AS (SELECT w, p, lam, c, CAST('0.01' AS DOUBLE) - near * sqrt(lam) AS r2, ln(c + 1) / 10 - near / 100 AS sr, near + CAST('0.001' AS DOUBLE) * lam AS bnrm FROM made)"""

ORACLES = {
    "panel_monthly": f"""WITH {RAW} SELECT yyyymm, {_r("Index", "D12", "E12", "b/m", "tbl", "AAA", "BAA", "lty", "ntis", "Rfree", "infl", "ltr", "corpr", "svar", "CRSP_SPvw")} FROM raw""",
    "panel_weekly": f"WITH {_panel(WEEK)} SELECT yyyymm, "
    + ", ".join(f'round("{c}" + 1e-8, 6) + 0.0 AS "{c}"' for c in ("Index", "D12", "E12", "b/m", "tbl", "AAA", "BAA", "lty", "ntis", "Rfree", "infl", "ltr", "corpr", "svar", "CRSP_SPvw"))
    + " FROM raw",
    "predictors_gw": f"WITH {RAW}, {GW} SELECT yyyymm, {_r(*PREDICTORS)} FROM gw",
    "excess_return": f"WITH {RAW} SELECT yyyymm, round(\"CRSP_SPvw\" - \"Rfree\", 6) + 0.0 AS mkt_excess FROM raw",
    "lagged_xy": f"WITH {RAW}, {GW}, {XY} SELECT yyyymm, {_r(*INPUTS, 'y')} FROM xy",
    "inner_join_panel": f"""WITH {RAW}, {GW}, ev AS (SELECT CAST(month(ts) + 199900 AS BIGINT) AS m, avg(value) AS factor FROM events GROUP BY year(ts), month(ts))
        SELECT yyyymm, {_r("dp", "tms", "factor")} FROM gw JOIN ev ON gw.yyyymm = ev.m""",
    "euro_csv_parse": "SELECT o_orderkey, round(round(o_totalprice, 2), 6) + 0.0 AS price FROM orders",
    "expanding_std_scale": f"""WITH {RAW}, n AS (
            SELECT yyyymm, "Index", tbl, row_number() OVER u AS k, stddev_samp("Index") OVER u AS si, stddev_samp(tbl) OVER u AS st
            FROM raw WINDOW u AS (ORDER BY yyyymm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        )
        SELECT yyyymm, round("Index" / CASE WHEN k < 36 THEN (SELECT si FROM n WHERE k = 36) ELSE si END, 6) + 0.0 AS "Index",
               round(tbl / CASE WHEN k < 36 THEN (SELECT st FROM n WHERE k = 36) ELSE st END, 6) + 0.0 AS tbl FROM n""",
    "trailing_rms_scale": f"""WITH {RAW}, v AS (SELECT yyyymm, ltr, row_number() OVER (ORDER BY yyyymm) AS k FROM raw WHERE ltr IS NOT NULL)
        SELECT yyyymm, CASE WHEN k > 12 THEN round(ltr / sqrt(avg(ltr * ltr) OVER (ORDER BY k ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), 6) + 0.0 END AS ltr FROM v""",
    "expanding_zscore": f"""WITH {RAW} SELECT yyyymm,
            CASE WHEN count("Index") OVER u >= 36 THEN round(("Index" - avg("Index") OVER u) / stddev_samp("Index") OVER u, 6) + 0.0 END AS "Index",
            CASE WHEN count(tbl) OVER u >= 36 THEN round((tbl - avg(tbl) OVER u) / stddev_samp(tbl) OVER u, 6) + 0.0 END AS tbl
        FROM raw WINDOW u AS (ORDER BY yyyymm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "rolling_zscore": f"""WITH {RAW} SELECT yyyymm, CASE WHEN count("Index") OVER u = 12 THEN round(("Index" - avg("Index") OVER u) / stddev_samp("Index") OVER u, 6) + 0.0 END AS "Index"
        FROM raw WINDOW u AS (ORDER BY yyyymm ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    "prefix_sums": f"""WITH {RAW} SELECT yyyymm, count(tbl) OVER u AS n, round(sum(tbl) OVER u, 6) + 0.0 AS s1, round(sum(tbl * tbl) OVER u, 6) + 0.0 AS s2
        FROM raw WINDOW u AS (ORDER BY yyyymm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "prepared_dataset": f"{BASE} SELECT CAST(t AS BIGINT) AS t, yyyymm, {_r(*INPUTS, 'y')} FROM prep",
    "p_grid": f"WITH {GRID.format(12000)} SELECT CAST(w AS BIGINT) AS window, CAST(row_number() OVER (PARTITION BY w ORDER BY part, p) - 1 AS BIGINT) AS pi, CAST(p AS BIGINT) AS p FROM grid",
    "feature_counts": f"WITH {GRID.format(100)} SELECT CAST(p AS BIGINT) AS p, CAST(p // 2 * 2 AS BIGINT) AS features FROM grid WHERE w = 12",
    "multiples_grid": "SELECT CAST(unnest(range(60, 12001, 60)) AS BIGINT) AS p",
    "windows_of_features": """SELECT n_features, string_agg(CAST(w AS VARCHAR), ',' ORDER BY w) AS windows
        FROM (SELECT w, CAST(unnest(range(w, 1201, w)) AS BIGINT) AS n_features FROM (VALUES (12), (60), (120)) AS x(w)) GROUP BY n_features""",
    "sweep_cross": f"""WITH {GRID.format(240)}, {_lams(LAMBDAS)} SELECT g.w AS window, CAST(seed AS BIGINT) AS seed, pi, p, lam FROM (
            SELECT CAST(w AS BIGINT) AS w, CAST(row_number() OVER (PARTITION BY w ORDER BY part, p) - 1 AS BIGINT) AS pi, CAST(p AS BIGINT) AS p FROM grid
        ) AS g, (VALUES (1), (2), (3), (4), (5)) AS x(seed), lams""",
    "rff_projection": f"{BASE} SELECT CAST(t AS BIGINT) AS t, yyyymm, "
    + ", ".join(f"round(2 * ({' + '.join(f'{c} * {_num(float(x))}' for c, x in zip(INPUTS, row, strict=True))}), 6) + 0.0 AS g{j + 1}" for j, row in enumerate(draw_weights(1, len(INPUTS), 2)))
    + " FROM prep",
    "rff_features": f"{BASE} SELECT CAST(t AS BIGINT) AS t, yyyymm, "
    + ", ".join(f"round({fn}(2 * ({' + '.join(f'{c} * {_num(float(x))}' for c, x in zip(INPUTS, row, strict=True))})), 6) + 0.0 AS z{2 * k + j + 1}" for k, fn in enumerate(("cos", "sin")) for j, row in enumerate(draw_weights(1, len(INPUTS), 2)))
    + " FROM prep",
    "ridge_p2": f"{_p2((1,))} SELECT yyyymm, {_r('y', 'yprd')} FROM pred",
    "beta_norm_p2": f"{_p2((1,))} SELECT yyyymm, {_r('bnrm')} FROM pred",
    "ridge_kernel_p2": f"{_p2((1, 2), LAMBDAS)} SELECT seed, yyyymm, lam, {_r('yprd', 'bnrm')} FROM pred",
    "ridge_small_p": f"{_base(WEEK)}, {_solved('pred', 3, (1,), (LAM,), T)} SELECT CAST(t AS BIGINT) AS t, yyyymm, {_r('y', 'yprd', 'bnrm')} FROM pred",
    "ridge_kernel_weekly": f"{_base(WEEK)}, {', '.join(_solved(f'w{w}h{h}', h, (1,), LAMBDAS, w) for w in (60, 120) for h in (1, 2))}, pred AS ("
    + " UNION ALL ".join(f"SELECT CAST({w} AS BIGINT) AS \"window\", CAST({2 * h} AS BIGINT) AS p, * FROM w{w}h{h}" for w in (60, 120) for h in (1, 2))
    + f") SELECT \"window\", yyyymm, p, lam, {_r('yprd', 'bnrm')} FROM pred",
    "run_metrics_small": f"{BASE}, {', '.join(_solved(f'h{h}', h, (1, 2), LAMBDAS, T) for h in (1, 2))}, pred AS ("
    + " UNION ALL ".join(f"SELECT CAST({2 * h} AS BIGINT) AS p, * FROM h{h}" for h in (1, 2))
    + f"), {_metrics('seed, lam, p')} SELECT subsample, p, lam, count(*) AS n_seeds, {_across()} FROM seeds GROUP BY subsample, p, lam",
    "timing_moments": f"{_per_seed()} SELECT subsample, seed, {_r('er', 'vol', 'sr')} FROM seeds",
    "oos_r2": f"{_per_seed()} SELECT subsample, seed, {_r('r2')} FROM seeds",
    "ols_alpha": f"{_per_seed()} SELECT subsample, seed, {_r('alpha', 'alpha_t', 'ir')} FROM seeds",
    "subsample_metrics": f"{_p2((1,))}, {_subs()} SELECT subsample, count(*) AS n, min(yyyymm) AS first, max(yyyymm) AS last, round(avg(bnrm), 6) + 0.0 AS bnrm FROM pred JOIN subs ON (lo IS NULL OR yyyymm >= lo) AND (hi IS NULL OR yyyymm <= hi) GROUP BY subsample",
    "seed_percentiles": f"{_per_seed()} SELECT subsample, count(*) AS n_seeds, {_across()} FROM seeds GROUP BY subsample",
    "mse_r2_classic": f"{_p2()} SELECT seed, round(avg((y - yprd) * (y - yprd)), 6) + 0.0 AS mse, round(1 - sum((y - yprd) * (y - yprd)) / (var_pop(y) * count(y)), 6) + 0.0 AS r2_classic FROM pred GROUP BY seed",
    "ct_oos_r2": f"""{_p2()}, b AS (SELECT *, avg(y) OVER (PARTITION BY seed ORDER BY yyyymm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM pred)
        SELECT seed, round(1 - sum((y - yprd) * (y - yprd)) / sum((y - past) * (y - past)), 6) + 0.0 AS r2_oos FROM b WHERE past IS NOT NULL GROUP BY seed""",
    "union_subsamples": f"{_p2((1,))}, {_subs()} SELECT yyyymm, round(yprd, 6) + 0.0 AS yprd, subsample FROM pred JOIN subs ON (lo IS NULL OR yyyymm >= lo) AND (hi IS NULL OR yyyymm <= hi)",
    "topk_configs": f"""{_per_seed(LAMBDAS)}, a AS (SELECT lam, avg(sr) AS sr_mean FROM seeds WHERE subsample = 'full' GROUP BY lam),
        r AS (SELECT *, row_number() OVER (ORDER BY sr_mean DESC, lam) AS up, row_number() OVER (ORDER BY sr_mean, lam) AS down FROM a)
        SELECT CAST(12 AS BIGINT) AS window, CAST(2 AS BIGINT) AS p, lam, {_r("sr_mean")}, 'best' AS side FROM r WHERE up <= 3
        UNION ALL SELECT 12, 2, lam, {_r("sr_mean")}, 'worst' FROM r WHERE down <= 3""",
    "plot_series": f"""{MADE} SELECT panel, CAST(w AS BIGINT) AS window, lam, round(c, 6) + 0.0 AS c, round(value, 6) + 0.0 AS value FROM (
            SELECT 'r2' AS panel, w, lam, c, r2 AS value FROM met UNION ALL SELECT 'sr', w, lam, c, sr * sqrt(12) FROM met UNION ALL SELECT 'bnrm', w, lam, c, bnrm FROM met)""",
    "acceptance_bands": f"""{MADE} SELECT CAST(w AS BIGINT) AS window, round(min(r2) FILTER (WHERE c > 0.5 AND c < 2), 6) + 0.0 AS r2_dip, round(avg(r2) FILTER (WHERE c > 50), 6) + 0.0 AS r2_tail,
            round(avg(sr) FILTER (WHERE c <= 0.5) * sqrt(12), 6) + 0.0 AS sr_head, round(min(sr) FILTER (WHERE c > 0.5 AND c < 2) * sqrt(12), 6) + 0.0 AS sr_near,
            round(avg(sr) FILTER (WHERE c > 50) * sqrt(12), 6) + 0.0 AS sr_tail, round(max(bnrm) FILTER (WHERE c > 0.5 AND c < 2) / greatest(avg(bnrm) FILTER (WHERE c > 50), 1e-12), 6) + 0.0 AS bnrm_spike
        FROM met WHERE lam = CAST('0.001' AS DOUBLE) GROUP BY w""",
    "describe_exact": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) + 0.0 AS mean, round(stddev_samp({c}), 6) + 0.0 AS std, round(min({c}), 6) + 0.0 AS min, round(quantile_cont({c}, 0.25), 6) + 0.0 AS p25, round(quantile_cont({c}, 0.5), 6) + 0.0 AS p50, round(quantile_cont({c}, 0.75), 6) + 0.0 AS p75, round(max({c}), 6) + 0.0 AS max FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
    "index_range": f"WITH {RAW} SELECT min(yyyymm) AS first, max(yyyymm) AS last, count(*) AS n FROM raw",
    "median_agg": "SELECT o_orderpriority, round(median(o_totalprice), 6) + 0.0 AS median_price FROM orders GROUP BY o_orderpriority",
    "covariance_gram": """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
        n AS (SELECT count(*) AS n FROM embeddings)
        SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(sum(a.x * b.x) / any_value(n.n), 6) + 0.0 AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.k <= b.k, n GROUP BY a.k, b.k""",
    "density_histogram": """WITH d AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, count(*) AS rows, (max(o_totalprice) - min(o_totalprice)) / 50 AS width FROM orders),
        c AS (SELECT least(CAST(floor((o_totalprice - a) / width) AS INTEGER), 49) AS bin, count(*) AS n FROM orders, d GROUP BY 1)
        SELECT CAST(k AS INTEGER) AS bin, round(a + k * width, 6) + 0.0 AS lo, round(a + (k + 1) * width, 6) + 0.0 AS hi, coalesce(n, 0) AS n, round(coalesce(n, 0) / (rows * width) * 1e6, 6) + 0.0 AS density_millionth
        FROM d, range(0, 50) AS r(k) LEFT JOIN c ON c.bin = r.k""",
}
