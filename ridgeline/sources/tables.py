"""Sources and sinks: locale-bound CSV, Parquet, and a period panel made of orders and lineitems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.config import FACTOR_FILE, PERIOD, PREDICTOR_FILE, RAW_COLUMNS


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def data_dir(spark: SparkSession, root: str) -> str:
    """The first of <root>/data and <root>/src/data that holds both input files."""
    tried = [f"{root}/data", f"{root}/src/data"]
    for d in tried:
        if exists(spark, f"{d}/{PREDICTOR_FILE}") and exists(spark, f"{d}/{FACTOR_FILE}"):
            return d
    raise FileNotFoundError(f"no folder with {PREDICTOR_FILE} and {FACTOR_FILE} among {tried}")


def euro_number(c: Column) -> Column:
    """'5.881,63' -> 5881.63; what is no number (empty, NaN) becomes null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), r"\.", ""), ",", ".")
    number = plain.try_cast("double")
    return F.when(~F.isnan(number), number)


def require(df: DataFrame, columns: list[str] | tuple[str, ...], name: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {missing}")
    return df


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)  # no inference: all strings, one pass


def predictors_csv(spark: SparkSession, path: str) -> DataFrame:
    """The raw predictor table, written with decimal commas and thousands points, in the order of its periods."""
    raw = require(_csv(spark, path), RAW_COLUMNS, path)
    return raw.select(F.col(PERIOD).cast("long").alias(PERIOD), *(euro_number(F.col(f"`{c}`")).alias(c) for c in RAW_COLUMNS[1:])).orderBy(PERIOD)


def factors_csv(spark: SparkSession, path: str) -> DataFrame:
    """Factor returns in percent, with decimal points."""
    raw = require(_csv(spark, path), (PERIOD, "Mkt-RF", "RF"), path)
    return raw.select(F.col(PERIOD).cast("long").alias(PERIOD), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns if c != PERIOD)).orderBy(PERIOD)


def parquet_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def month_of(ts: str) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("long")


def week_of(ts: str) -> Column:
    return F.floor(F.datediff(F.to_date(ts), F.lit("1995-01-02").cast("date")) / 7).cast("long")


def period_panel(orders: DataFrame, lineitem: DataFrame, period=month_of) -> DataFrame:
    """Orders and lineitems in the part of the raw table. Both sides shrink to periods before they meet."""
    o = orders.groupBy(period("o_orderdate").alias(PERIOD)).agg(F.avg("o_totalprice").alias("Index"), F.count("*").cast("double").alias("orders"))
    of_flag = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_discount")))
    line = lineitem.groupBy(period("l_shipdate").alias(PERIOD)).agg(
        F.avg(F.col("l_extendedprice") * F.col("l_discount")).alias("D12"),
        F.avg("l_extendedprice").alias("E12"),
        F.avg("l_tax").alias("tbl"),
        F.avg("l_discount").alias("lty"),
        of_flag("R").alias("BAA"),
        of_flag("A").alias("AAA"),
        F.avg("l_quantity").alias("qty"),
        F.var_samp("l_discount").alias("svar"),
    )
    w = Window.orderBy(PERIOD)
    growth = lambda c: F.try_divide(F.col(c), F.lag(c).over(w)) - 1
    return o.join(line, PERIOD).select(
        PERIOD, "Index", "D12", "E12", (F.col("qty") / 50).alias("b/m"), "tbl", "AAA", "BAA", "lty",
        growth("orders").alias("ntis"), (F.col("tbl") / 12).alias("Rfree"), growth("E12").alias("infl"), growth("qty").alias("ltr"),
        growth("lty").alias("corpr"), "svar", growth("Index").alias("CRSP_SPvw"),
    )


def write_metrics(metrics: DataFrame, out_dir: str) -> None:
    """One Parquet folder, a partition for each window, which is pruned on reading."""
    metrics.write.mode("overwrite").partitionBy("window").parquet(f"{out_dir}/metrics")


def write_predictions(predictions: DataFrame, out_dir: str) -> None:
    """window and seed become partition columns, so that reading gives them back; pi tells repeated grid points apart."""
    out = predictions.select("window", "seed", F.col(PERIOD).alias("date"), "pi", "p", "lam", "yprd", "bnrm", F.col("y").alias("y_true"))
    out.write.mode("overwrite").partitionBy("window", "seed").parquet(f"{out_dir}/predictions")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
