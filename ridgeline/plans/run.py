"""The whole run: inputs, sweep, metrics for each seed and subsample, aggregates, files."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from ridgeline.config import PREDICTOR_FILE, RunConfig
from ridgeline.operators.grids import subsample_frame
from ridgeline.operators.metrics import across_seeds, seed_metrics, with_subsamples
from ridgeline.operators.predictors import INPUTS
from ridgeline.operators.ridge import rolling_ridge
from ridgeline.operators.scaling import prepare
from ridgeline.sources.tables import data_dir, predictors_csv, write_metrics, write_predictions


def metrics_of(predictions: DataFrame, cfg: RunConfig) -> DataFrame:
    """Metrics of each seed first, then their mean and percentiles; repeated grid points stay apart by their number."""
    spread = with_subsamples(predictions, subsample_frame(predictions.sparkSession, cfg.subsamples))
    per_seed = seed_metrics(spread, ["window", "subsample", "seed", "pi", "p", "lam"])
    return across_seeds(per_seed, ["window", "subsample", "pi", "p", "lam"]).drop("pi")


def predict(raw: DataFrame, cfg: RunConfig) -> DataFrame:
    return rolling_ridge(prepare(raw), list(INPUTS), cfg)


def run(spark: SparkSession, raw: DataFrame, cfg: RunConfig) -> DataFrame:
    """Writes metrics (and predictions, if asked for) under cfg.out_dir; gives the metrics as read back."""
    predictions = predict(raw, cfg)
    if cfg.save_predictions:
        write_predictions(predictions, cfg.out_dir)
        predictions = spark.read.parquet(f"{cfg.out_dir}/predictions").withColumnsRenamed({"date": "yyyymm", "y_true": "y"})
    write_metrics(metrics_of(predictions, cfg), cfg.out_dir)
    return spark.read.parquet(f"{cfg.out_dir}/metrics")


def parse_args(argv: list[str] | None = None) -> tuple[RunConfig, str]:
    """A run's parameters, an option for each field of RunConfig that has a plain value, and the folder of the inputs."""
    parser = argparse.ArgumentParser(description="Random-feature ridge forecasts, out of sample.")
    plain = [f for f in fields(RunConfig) if f.name != "subsamples"]
    for f in plain:
        kind, many = type(f.default), isinstance(f.default, tuple)
        how = {"action": "store_true"} if kind is bool else {"type": type(f.default[0]), "nargs": "+"} if many else {"type": kind}
        parser.add_argument("--" + f.name.replace("_", "-"), default=f.default, **how)
    parser.add_argument("--root", default=".", help="folder of the input files, if no environment variable names it")
    given = vars(parser.parse_args(argv))
    return RunConfig(**{f.name: tuple(v) if isinstance(v := given[f.name], list) else v for f in plain}), given["root"]


def main(argv: list[str] | None = None) -> None:
    cfg, root = parse_args(argv)
    spark = SparkSession.builder.appName("ridgeline").getOrCreate()
    run(spark, predictors_csv(spark, f"{data_dir(spark, root)}/{PREDICTOR_FILE}"), cfg).groupBy("window").count().orderBy("window").show()


if __name__ == "__main__":
    main()
