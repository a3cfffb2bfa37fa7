"""Rolling ridge of few features in window functions alone, by elimination on windowed moments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.numeric import ieee_div
from ridgeline.operators.predictors import ordered


def rolling_ridge(df: DataFrame, window: int, lam: float | tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds (yprd, bnrm) to rows (t, z1.., y): row t is predicted from the `window` rows before it.

    Each window scales features by their own standard deviation in it, the predicted row's too; there is no
    intercept and the penalty is lam * window. Rows with fewer rows before them leave. The normal
    equations are solved by symmetric elimination, one projection for each pivot. Several penalties make a row
    each, told by `lam`; they share the moments.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    z = [c for c in df.columns if c[0] == "z" and c[1:].isdigit()]
    n, w = len(z), ordered(by).rowsBetween(-window, -1)
    keep = [c for c in df.columns if c not in z]
    rows = df.withColumns({f"__s{i}": F.stddev_samp(z[i]).over(w) for i in range(n)} | {"__n": F.count("*").over(w)})
    moments = {f"__k{i}_{j}": F.sum(F.col(z[i]) * F.col(z[j])).over(w) for i in range(n) for j in range(i, n)} | {f"__r{i}": F.sum(F.col(z[i]) * F.col("y")).over(w) for i in range(n)}
    rows = rows.withColumns(moments).where(F.col("__n") == window)
    penalty = F.lit(float(lam)) if isinstance(lam, (int, float)) else F.col("lam")
    if not isinstance(lam, (int, float)):
        rows = rows.withColumn("lam", F.explode(F.array(*(F.lit(float(x)) for x in lam))))
        keep = [*keep, "lam"]
    s = [F.col(f"__s{i}") for i in range(n)]
    rows = rows.select(
        *keep,
        *(ieee_div(F.col(z[i]), s[i]).alias(f"__z{i}") for i in range(n)),
        *((ieee_div(F.col(f"__k{i}_{j}"), s[i] * s[j]) + (penalty * window if i == j else 0.0)).alias(f"__k{i}_{j}") for i in range(n) for j in range(i, n)),
        *(ieee_div(F.col(f"__r{i}"), s[i]).alias(f"__r{i}") for i in range(n)),
    )
    k = lambda i, j: F.col(f"__k{min(i, j)}_{max(i, j)}")
    for p in range(n - 1):
        ratio = {i: F.try_divide(k(p, i), k(p, p)) for i in range(p + 1, n)}
        rows = rows.withColumns({f"__k{i}_{j}": k(i, j) - ratio[i] * k(p, j) for i in range(p + 1, n) for j in range(i, n)} | {f"__r{i}": F.col(f"__r{i}") - ratio[i] * F.col(f"__r{p}") for i in range(p + 1, n)})
    for i in reversed(range(n)):
        later = sum((k(i, j) * F.col(f"__b{j}") for j in range(i + 1, n)), F.lit(0.0))
        rows = rows.withColumn(f"__b{i}", F.try_divide(F.col(f"__r{i}") - later, k(i, i)))
    yprd = sum((F.col(f"__b{i}") * F.col(f"__z{i}") for i in range(n)), F.lit(0.0))
    bnrm = sum((F.col(f"__b{i}") * F.col(f"__b{i}") for i in range(n)), F.lit(0.0))
    return rows.select(*keep, yprd.alias("yprd"), bnrm.alias("bnrm"))
