"""Gaussian process with an RBF kernel, approximated by random Fourier features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .features import rbf_features
from .linear import Coefficients, DotProductProcess
from .moments import collect_moments, total


def gpr_rbf(
    df: DataFrame, alpha: float = 1.0, gammas: tuple[float, ...] = (0.05, 0.2, 0.5, 1.0, 2.0), components: int = 100,
    seed: int = 42,
) -> tuple[float, Coefficients]:
    """(gamma of the largest marginal likelihood, coefficients on its Fourier features). No bias term."""
    best = None
    for gamma in gammas:
        process = DotProductProcess(total(collect_moments(rbf_features(df, gamma, components, seed))), alpha)
        value = process.log_likelihood(0.0)
        if best is None or value > best[0]:
            best = (value, gamma, process.solve(0.0))
    return best[1], best[2]
