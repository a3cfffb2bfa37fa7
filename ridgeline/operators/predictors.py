"""From raw columns to lagged, complete model inputs. `by` names series that are handled apart (and in parallel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ridgeline.config import PERIOD, PREDICTORS
from ridgeline.sources.tables import require

INPUTS = (*PREDICTORS, "lag_mkt")


def ordered(by: tuple[str, ...] = ()) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(PERIOD) if by else Window.orderBy(PERIOD)


def _predictors(by: tuple[str, ...]) -> list[Column]:
    made = {
        "dfy": F.col("BAA") - F.col("AAA"),
        "infl": F.col("infl"),
        "svar": F.col("svar"),
        "de": F.ln("D12") - F.ln("E12"),
        "lty": F.col("lty"),
        "tms": F.col("lty") - F.col("tbl"),
        "tbl": F.col("tbl"),
        "dfr": F.col("corpr") - F.col("ltr"),
        "dp": F.ln("D12") - F.ln("Index"),
        "dy": F.ln("D12") - F.lag(F.ln("Index")).over(ordered(by)),
        "ltr": F.col("ltr"),
        "ep": F.ln("E12") - F.ln("Index"),
        "bm": F.col("`b/m`"),
        "ntis": F.col("ntis"),
    }
    return [made[c].alias(c) for c in PREDICTORS]


def _return() -> Column:
    return F.col("CRSP_SPvw") - F.col("Rfree")


def build_predictors(raw: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The 14 predictors at their own period, in the fixed order. Logs of what is not positive are null."""
    require(raw, ("D12", "E12", "Index", "BAA", "AAA", "lty", "tbl", "corpr", "ltr", "b/m", "infl", "svar", "ntis"), "raw table")
    return raw.select(*by, PERIOD, *_predictors(by))


def excess_return(raw: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return raw.select(*by, PERIOD, _return().alias("mkt_excess"))


def lagged_xy(raw: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(yyyymm, the 14 predictors and lag_mkt of the row before, y): the complete rows.

    Lags go by row, over all rows; incomplete rows leave afterwards, so the filter stays above the window.
    """
    now = raw.select(*by, PERIOD, *_predictors(by), _return().alias("y"))
    w = ordered(by)
    before = [F.lag(c).over(w).alias(c) for c in PREDICTORS]
    return now.select(*by, PERIOD, *before, F.lag("y").over(w).alias("lag_mkt"), "y").dropna(subset=[*INPUTS, "y"])


def lag_complete(df: DataFrame, columns: list[str], target: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The older generation's inputs: given columns as they are, one row late, complete rows only."""
    w = ordered(by)
    return df.select(*by, PERIOD, *(F.lag(c).over(w).alias(c) for c in columns), target).dropna(subset=[*columns, target])


def with_factors(predictors: DataFrame, factors: DataFrame) -> DataFrame:
    """Inner join on the period, in its order."""
    return predictors.join(factors, PERIOD).orderBy(PERIOD)
