"""Seeded inputs: weights of random features, and regressions whose signal is in a few inputs."""

from __future__ import annotations

import numpy as np


def draw_weights(seed: int, n_inputs: int, max_half: int) -> np.ndarray:
    """[max_half, n_inputs] standard normal draws; a smaller draw of a seed is the start of a larger one."""
    return np.random.default_rng(seed).standard_normal((max_half, n_inputs))


def signal(x: np.ndarray, beta: np.ndarray, curved: bool = False) -> np.ndarray:
    """The noiseless response: x beta, or its square over the number of inputs that matter."""
    line = x @ beta
    return line**2 / np.count_nonzero(beta) if curved else line


def regression_sample(rows: int, beta: np.ndarray, noise: float, stream: int, curved: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of standard normal inputs and signal() with normal noise of that deviation; inputs and noise have streams of their own."""
    inputs, errors = (np.random.default_rng((stream, part)) for part in (0, 1))
    x = inputs.standard_normal((rows, len(beta)))
    return x, signal(x, beta, curved) + noise * errors.standard_normal(rows)


def sparse_beta(width: int, active: int, stream: int) -> np.ndarray:
    """Coefficients of which only the first `active` differ from zero."""
    return np.pad(np.random.default_rng((stream, 2)).standard_normal(active), (0, width - active))
