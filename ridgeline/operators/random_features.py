"""Random Fourier features as column expressions, for few features."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.config import GAMMA


def projection(inputs: list[str], weights: np.ndarray, gamma: float = GAMMA) -> list[Column]:
    """gamma * W x, a column for each row of the weights."""
    return [(reduce(lambda a, b: a + b, (F.col(c) * float(w) for c, w in zip(inputs, row, strict=True))) * gamma).alias(f"g{j + 1}") for j, row in enumerate(weights)]


def features(df: DataFrame, inputs: list[str], weights: np.ndarray, gamma: float = GAMMA) -> DataFrame:
    """Replaces the inputs by z1..: the cosines of all projections, then the sines."""
    rest = [c for c in df.columns if c not in inputs]
    at = df.select(*rest, *projection(inputs, weights, gamma))
    half = len(weights)
    return at.select(*rest, *(F.cos(f"g{j + 1}").alias(f"z{j + 1}") for j in range(half)), *(F.sin(f"g{j + 1}").alias(f"z{half + j + 1}") for j in range(half)))


def scaled_features(x: np.ndarray, n: int = 1000, gamma: float = 0.5, seed: int = 123) -> np.ndarray:
    """The older generation's variant: weights of variance 2 gamma, features over sqrt(n)."""
    g = x @ np.random.default_rng(seed).normal(scale=np.sqrt(2 * gamma), size=(x.shape[1], n))
    return np.hstack([np.cos(g), np.sin(g)]) / np.sqrt(n)


def phase_features(x: np.ndarray, n: int = 1000, gamma: float = 0.5, seed: int = 123) -> np.ndarray:
    """The cosine-with-phase variant: sqrt(2/n) cos(XW + b)."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=np.sqrt(2 * gamma), size=(x.shape[1], n)), rng.uniform(0, 2 * np.pi, n)
    return np.sqrt(2 / n) * np.cos(x @ w + b)
