"""Causal scalers as window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import BURN_IN, PERIOD, TARGET_ROWS
from ridgeline.functions.numeric import finite_or_null, ieee_div
from ridgeline.operators.predictors import INPUTS, lagged_xy, ordered


def _upto(by):
    return ordered(by).rowsBetween(Window.unboundedPreceding, 0)


def expanding_std(df: DataFrame, columns: list[str], by: tuple[str, ...] = (), min_obs: int = BURN_IN, check: bool = False) -> DataFrame:
    """x / the standard deviation of all rows up to its own; the first min_obs rows use that of the first min_obs rows.

    Values that are not finite are left out of the deviations. check: raises if a series is shorter
    than min_obs (that takes a pass); else its rows become null.
    """
    if check and (short := df.groupBy(*by).count().where(F.col("count") < min_obs).first() if by else (n if (n := df.count()) < min_obs else None)):
        raise ValueError(f"needs at least {min_obs} rows: {short}")
    first = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows = df.withColumn("__n", F.row_number().over(ordered(by)))
    rows = rows.withColumns({f"__s_{c}": F.stddev_samp(finite_or_null(F.col(c))).over(_upto(by)) for c in columns})
    block = {f"__b_{c}": F.max(F.when(F.col("__n") == min_obs, F.col(f"__s_{c}"))).over(first) for c in columns}
    rows = rows.withColumns(block)
    scaled = {c: ieee_div(F.col(c), F.when(F.col("__n") < min_obs, F.col(f"__b_{c}")).otherwise(F.col(f"__s_{c}"))) for c in columns}
    return rows.withColumns(scaled).select(*df.columns)


def trailing_rms(df: DataFrame, column: str, by: tuple[str, ...] = (), rows: int = TARGET_ROWS) -> DataFrame:
    """y / the root mean square of the `rows` rows before its own; null until there are as many."""
    w = ordered(by).rowsBetween(-rows, -1)
    y = F.col(column)
    full = F.count(y).over(w) == rows
    return df.withColumn(column, F.when(full, ieee_div(y, F.sqrt(F.avg(y * y).over(w)))))


def expanding_zscore(df: DataFrame, columns: list[str], by: tuple[str, ...] = (), min_obs: int = BURN_IN) -> DataFrame:
    """(x - mean) / deviation of all rows up to its own; null until there are min_obs values."""
    w = _upto(by)
    return df.withColumns({c: F.when(F.count(c).over(w) >= min_obs, ieee_div(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w))) for c in columns})


def rolling_zscore(df: DataFrame, column: str, by: tuple[str, ...] = (), rows: int = TARGET_ROWS) -> DataFrame:
    """(x - mean) / deviation of the last `rows` rows, its own among them (so it is not causal)."""
    w = ordered(by).rowsBetween(1 - rows, 0)
    return df.withColumn(column, F.when(F.count(column).over(w) == rows, ieee_div(F.col(column) - F.avg(column).over(w), F.stddev_samp(column).over(w))))


def prefix_sums(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(count, sum, sum of squares) of all rows up to its own."""
    w, c = _upto(by), F.col(column)
    return df.select(*by, PERIOD, F.count(c).over(w).alias("n"), F.sum(c).over(w).alias("s1"), F.sum(c * c).over(w).alias("s2"))


def prepare(raw: DataFrame, by: tuple[str, ...] = (), burn_in: int = BURN_IN) -> DataFrame:
    """(t, yyyymm, x1.. as named, y): lagged inputs and the lagged return scaled alike, the target by its own RMS, without the burn-in."""
    xy = lagged_xy(raw, by)
    scaled = trailing_rms(expanding_std(xy, list(INPUTS), by), "y", by)
    numbered = scaled.withColumn("t", F.row_number().over(ordered(by)).cast("long") - burn_in)
    return numbered.where(F.col("t") > 0).select(*by, "t", PERIOD, *INPUTS, "y")
