"""Linear regressors solved on the driver from d x d moments.

Every function takes ``Moments`` and returns ``(intercept, coefficients)``. The rows were
reduced by Spark; nothing here depends on how many there were.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .moments import Moments, total

Coefficients = tuple[float, np.ndarray]


def _with_intercept(m: Moments, coef: np.ndarray) -> Coefficients:
    return float(m.mean_y - m.mean_x @ coef), coef


def ols(m: Moments) -> Coefficients:
    """Least squares with intercept; the minimum-norm solution when columns are dependent."""
    return _with_intercept(m, np.linalg.pinv(m.sxx, hermitian=True) @ m.sxy)


def ridge(m: Moments, alpha: float = 1.0) -> Coefficients:
    """Squared loss plus alpha |w|^2, intercept unpenalised."""
    return _with_intercept(m, np.linalg.solve(m.sxx + alpha * np.eye(len(m.sxy)), m.sxy))


@dataclass(frozen=True)
class DotProductProcess:
    """Gaussian process with kernel s^2 + a.b and noise alpha, in its primal form.

    With Z = (s, X) the posterior mean at x is (s, x)'(Z'Z + alpha I)^-1 Z'y, and the
    marginal likelihood needs only Z'Z, Z'y and y'y. The target is not centred.
    """

    m: Moments
    alpha: float

    def _system(self, s: float) -> tuple[np.ndarray, np.ndarray, float]:
        xx, xy, sums, yy = self.m.raw()
        d = len(xy)
        z = np.empty((d + 1, d + 1))
        z[0, 0], z[0, 1:], z[1:, 0], z[1:, 1:] = s * s * self.m.n, s * sums, s * sums, xx
        return z + self.alpha * np.eye(d + 1), np.concatenate([[s * self.m.n * self.m.mean_y], xy]), yy

    def log_likelihood(self, s: float) -> float:
        a, zy, yy = self._system(s)
        lower = np.linalg.cholesky(a)
        half = np.linalg.solve(lower, zy)
        n, p = self.m.n, len(zy)
        log_det = (n - p) * np.log(self.alpha) + 2 * np.log(np.diag(lower)).sum()
        return float(-0.5 * (yy - half @ half) / self.alpha - 0.5 * log_det - 0.5 * n * np.log(2 * np.pi))

    def best_scale(self, low: float = 1e-5, high: float = 1e5) -> float:
        """s of the largest likelihood: a grid on log s, then golden-section steps around its best point."""
        grid = np.linspace(np.log(low), np.log(high), 47)
        values = [self.log_likelihood(np.exp(g)) for g in grid]
        i = int(np.argmax(values))
        a, b = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
        ratio = (np.sqrt(5) - 1) / 2
        for _ in range(40):
            c, e = b - ratio * (b - a), a + ratio * (b - a)
            if self.log_likelihood(np.exp(c)) >= self.log_likelihood(np.exp(e)):
                b = e
            else:
                a = c
        return float(np.exp((a + b) / 2))

    def solve(self, s: float) -> Coefficients:
        a, zy, _ = self._system(s)
        w = np.linalg.solve(a, zy)
        return float(s * w[0]), w[1:]


def gpr_linear(m: Moments, alpha: float = 1.0, scale: float | None = None) -> Coefficients:
    process = DotProductProcess(m, alpha)
    return process.solve(process.best_scale() if scale is None else scale)


def coordinate_descent(
    m: Moments, alpha: float, l1_ratio: float, start: np.ndarray | None = None, tol: float = 1e-6, max_iter: int = 2000
) -> np.ndarray:
    """Minimise 1/(2n)|y - Xw|^2 + alpha l1_ratio |w|_1 + alpha (1 - l1_ratio)/2 |w|^2 on centred moments."""
    q, r = m.sxx / m.n, m.sxy / m.n
    w = np.zeros(len(r)) if start is None else start.copy()
    gradient = q @ w
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(max_iter):
        largest = 0.0
        for j in np.flatnonzero(np.diag(q) + l2 > 0):
            rho = r[j] - gradient[j] + q[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (q[j, j] + l2)
            change = new - w[j]
            if change:
                gradient += change * q[:, j]
                w[j] = new
                largest = max(largest, abs(change))
        if largest <= tol * max(1e-12, np.abs(w).max()):
            break
    return w


def alpha_path(m: Moments, l1_ratio: float, n_alphas: int = 100, eps: float = 1e-3) -> np.ndarray:
    top = np.abs(m.sxy).max() / m.n / max(l1_ratio, 1e-3)
    return np.geomspace(top, top * eps, n_alphas)


def elastic_net_cv(
    folds: list[Moments], l1_ratio: float = 0.5, n_alphas: int = 100, tol: float = 1e-6, normalize: bool = False
) -> tuple[float, Coefficients]:
    """(alpha, coefficients): alpha with the smallest mean held-out squared error over the path."""
    whole = total(dict(enumerate(folds)))
    scale = np.sqrt(np.diag(whole.sxx)) if normalize else np.ones(len(whole.sxy))
    scale = np.where(scale > 0, scale, 1.0)
    folds = [f.project(np.diag(1 / scale)) for f in folds]
    whole = whole.project(np.diag(1 / scale))
    alphas = alpha_path(whole, l1_ratio, n_alphas)
    errors = np.zeros(n_alphas)
    for held in folds:
        train, w = whole.minus(held), None
        for i, alpha in enumerate(alphas):
            w = coordinate_descent(train, alpha, l1_ratio, w, tol)
            errors[i] += held.squared_error(*_with_intercept(train, w)) / held.n / len(folds)
    best = float(alphas[int(np.argmin(errors))])
    w = None
    for alpha in alphas[alphas >= best]:
        w = coordinate_descent(whole, alpha, l1_ratio, w, tol)
    intercept, coef = _with_intercept(whole, w)
    return best, (intercept, coef / scale)


def lasso_cv(folds: list[Moments], n_alphas: int = 100, normalize: bool = False) -> tuple[float, Coefficients]:
    return elastic_net_cv(folds, 1.0, n_alphas, normalize=normalize)
