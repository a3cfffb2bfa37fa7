"""Parameters of a run, and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

# The published protocol's parameters.
GAMMA = 2.0
MAX_P = 12_000
LAMBDAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
WINDOWS = (12, 60, 120)
BURN_IN = 36
TARGET_ROWS = 12
SUBSAMPLES = ((1926, 2020), (1926, 1974), (1975, 2020))
PERCENTILES = (1, 2.5, 5, 25, 50, 75, 95, 97.5, 99)
PREDICTORS = ("dfy", "infl", "svar", "de", "lty", "tms", "tbl", "dfr", "dp", "dy", "ltr", "ep", "bm", "ntis")
METRICS = ("r2", "er", "vol", "sr", "alpha", "alpha_t", "ir", "bnrm")
PERIOD = "yyyymm"
PREDICTOR_FILE = "15-predictors.csv"
FACTOR_FILE = "fama-french-return.csv"
RAW_COLUMNS = ("yyyymm", "Index", "D12", "E12", "b/m", "tbl", "AAA", "BAA", "lty", "ntis", "Rfree", "infl", "ltr", "corpr", "svar", "csp", "CRSP_SPvw", "CRSP_SPvwx")


@dataclass(frozen=True)
class RunConfig:
    """A sweep: windows x seeds, each over a grid of feature counts and the penalties."""

    windows: tuple[int, ...] = WINDOWS
    n_seeds: int = 10
    first_seed: int = 1
    max_p: int = MAX_P
    lambdas: tuple[float, ...] = LAMBDAS
    gamma: float = GAMMA
    dtype: str = "float64"
    out_dir: str = "artifacts"
    save_predictions: bool = False
    chunk_windows: int = 64
    chunk_half_features: int = 256
    subsamples: tuple[tuple[int, int], ...] = field(default=SUBSAMPLES)

    def __post_init__(self) -> None:
        if self.dtype not in ("float64", "float32"):
            raise ValueError(f"dtype must be float64 or float32, not {self.dtype}")
        if self.n_seeds < 1 or self.chunk_windows < 1 or self.chunk_half_features < 1:
            raise ValueError("n_seeds, chunk_windows and chunk_half_features must be positive")
        if any(w < 2 for w in self.windows):
            raise ValueError("a window needs at least 2 rows, else its standard deviation is undefined")

    @property
    def seeds(self) -> list[int]:
        return list(range(self.first_seed, self.first_seed + self.n_seeds))
