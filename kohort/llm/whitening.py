"""Whitening of embeddings by principal components from a block Jacobi-Davidson iteration.

The covariance is never formed: the iteration only asks for its product with a few vectors, sum of (x - mean) ((x - mean)' v)
over the rows, which is one distributed pass for all vectors of a block. Components fit into a search space V:

1. Rayleigh-Ritz: eigenvectors of the small matrix V'AV give Ritz vectors and their residuals A u - e u.
2. Ritz vectors whose residual is down to double precision are locked, largest eigenvalue first; later corrections stay orthogonal to them.
3. For each open vector the projected correction equation (I - QQ')(A - e I)(I - QQ') t = -r, Q the locked vectors and u,
   is solved roughly by MINRES. All open vectors take their inner steps side by side, so an inner step is one pass, too.
4. The corrections enter V; beyond ``most`` vectors V restarts from the best Ritz vectors.

It ends when all wanted vectors are locked, and raises where that does not happen within ``outer`` rounds. The residuals
are checked by a product of their own at the end. What the driver holds is d times the size of V. Sums of a pass are merged
on the executors, so the driver gets one array per pass however many tasks there are.

Entries are first put on an integer grid, x = floor(scale * c) + shift. Column sums and the squared deviations n x - S are
whole numbers and exact; rows are centred in two steps, by the nearest integer and then by the small remainder, before anything is
multiplied, so the large shift costs no digits.

Defined cases: null vectors and those with null or non-finite entries take no part; nor do vectors whose length is not the most frequent one
(of equally frequent ones the longest), as they lie in another space, and empty ones. Repeated rows count each time, a null id is kept. Directions without variance
have no component: up to min(k, rank) are returned, none for a single row or equal rows. An empty table gives an empty result;
further columns are ignored. Whole numbers beyond the range of a long raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.arrays import list_array, matrix, sum_arrays
from .common import give_back, small_batches, stage

EPS = float(np.finfo(float).eps)
#: rows held at once as a matrix
ROWS = 2048


@dataclass(frozen=True)
class Fit:
    """Mean as a whole number and a remainder, eigenvalues falling, unit vectors as columns, largest entry positive."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = [(s - c * self.n) / self.n for s, c in zip(self.sums, near)]
        return np.array(near, np.int64), np.array(rest)


def gridded(table: DataFrame, id: str, vector: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, x): the rows that take part, on the integer grid."""
    v = F.col(f"`{vector}`")
    rows = table.select(F.col(f"`{id}`").cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size(v) > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    )
    rows = stage(rows.select("vec_id", F.transform("v", lambda e: F.floor(e * scale).cast("long") + shift).alias("x")))
    width = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows if width is None else rows.where(F.size("x") == width["d"])


def summed(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``work`` over blocks of rows, merged on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in small_batches(batches, ROWS):
            part = work(matrix(batch, "x", np.int64))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([list_array(total.reshape(1, -1))], ["s"])
        give_back()

    return np.asarray(sum_arrays(rows.select("x").mapInArrow(run, "s array<double>"), "s").first()["s"]).reshape(shape)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the whole sums of the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in small_batches(batches, ROWS):
            if batch.num_rows:
                x = matrix(batch, "x", np.int64)
                part = x.astype(object).sum(0) if np.abs(x).max() > 2**50 else x.sum(0).astype(object)
                n, sums = n + len(x), part if sums is None else sums + part
        if n:
            places, totals = np.arange(-1, len(sums)), [n, *map(int, sums)]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(totals, pa.int64())], ["place", "s"])
        give_back()

    found = rows.select("x").mapInArrow(run, "place int, s long").groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    at = {r["place"]: int(r["s"]) for r in found.collect()}
    return at.get(-1, 0), [at[i] for i in range(len(at) - 1)]


def minres(apply: Callable[[np.ndarray, np.ndarray], np.ndarray], b: np.ndarray, reduce: float, most: int) -> np.ndarray:
    """MINRES for symmetric systems side by side, one per column; ``apply(vectors, columns)`` multiplies the open ones.

    A column is done when its residual has fallen by ``reduce``; the others go on.
    """
    x = np.zeros_like(b)
    norm = np.linalg.norm(b, axis=0)
    beta, eta = norm.copy(), norm.copy()
    v_old, v = np.zeros_like(b), b / np.where(norm > 0, norm, 1)
    w_old, w = np.zeros_like(b), np.zeros_like(b)
    c_old, c = np.ones(len(norm)), np.ones(len(norm))
    s_old, s = np.zeros(len(norm)), np.zeros(len(norm))
    open = norm > 0
    coupled = np.zeros(len(norm))
    for _ in range(most):
        at = np.flatnonzero(open)
        if not len(at):
            break
        p = apply(v[:, at], at)
        alpha = (p * v[:, at]).sum(0)
        p = p - alpha * v[:, at] - coupled[at] * v_old[:, at]
        beta_new = np.linalg.norm(p, axis=0)
        # two Givens rotations turn the tridiagonal column into the triangle
        delta = c[at] * alpha - c_old[at] * s[at] * coupled[at]
        over = s[at] * alpha + c_old[at] * c[at] * coupled[at]
        far = s_old[at] * coupled[at]
        length = np.hypot(delta, beta_new)
        ok = length > 0
        length = np.where(ok, length, 1)
        c_new, s_new = delta / length, beta_new / length
        w_new = (v[:, at] - over * w[:, at] - far * w_old[:, at]) / length
        x[:, at] += np.where(ok, c_new * eta[at], 0) * w_new
        eta[at] = -s_new * eta[at]
        w_old[:, at], w[:, at] = w[:, at], w_new
        c_old[at], s_old[at], c[at], s[at] = c[at], s[at], c_new, s_new
        v_old[:, at], v[:, at] = v[:, at], p / np.where(beta_new > 0, beta_new, 1)
        coupled[at], beta[at] = beta_new, beta_new
        open[at] = ok & (np.abs(eta[at]) > reduce * norm[at]) & (beta_new > EPS * norm[at])
    return x


def orthonormal(basis: np.ndarray, new: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """Unit vectors that extend the orthonormal ``basis`` by the columns of ``new``; what adds no direction is left out."""
    added = np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            column = column - basis @ (basis.T @ column)
            column = column - added @ (added.T @ column)
        left = np.linalg.norm(column)
        if left > floor and basis.shape[1] + added.shape[1] < len(new):
            column = column / left
            column -= basis @ (basis.T @ column)
            column -= added @ (added.T @ column)
            added = np.column_stack([added, column / np.linalg.norm(column)])
    return added


def jacobi_davidson(
    product: Callable[[np.ndarray], np.ndarray], d: int, k: int, scale: float, outer: int = 60, inner: int = 6, most: int | None = None, seed: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a positive semidefinite matrix of size ``d``, and their unit vectors.

    ``product`` multiplies a block of vectors. ``scale`` is a bound of the norm, such as the trace. Residuals come down to
    ``64 * EPS`` times the largest eigenvalue. The search space holds at most ``most`` vectors, 3 k by default.
    """
    most = min(d, most or max(3 * k, k + 16))
    begin = np.random.Generator(np.random.PCG64(seed)).normal(size=(d, min(d, k + 4)))
    v = orthonormal(np.zeros((d, 0)), begin)
    av = product(v)
    locked, level = np.zeros((d, 0)), np.zeros(0)
    for round in range(outer):
        h = v.T @ av
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = v @ y, av @ y
        wanted = min(k, len(theta))
        residual = au[:, :wanted] - u[:, :wanted] * theta[:wanted]
        size = np.linalg.norm(residual, axis=0)
        limit = 64 * EPS * max(theta[0], EPS * scale)
        closed = size <= limit
        # locked in falling order: a vector below an open one could still be overtaken
        done = wanted if closed.all() else int(np.argmin(closed))
        locked, level = u[:, :done], theta[:done]
        if done == k or len(theta) == d and round > 2 and (size <= 16 * limit).all():
            return theta[:wanted], u[:, :wanted]
        at = np.flatnonzero(~closed)
        at = at[at >= done]

        def projected(x: np.ndarray, columns: np.ndarray) -> np.ndarray:
            own = u[:, at[columns]]

            def clean(z: np.ndarray) -> np.ndarray:
                z = z - locked @ (locked.T @ z)
                return z - own * (own * z).sum(0)

            x = clean(x)
            return clean(product(x) - theta[at[columns]] * x)

        r = residual[:, at]
        r = r - locked @ (locked.T @ r)
        r = r - u[:, at] * (u[:, at] * r).sum(0)
        if v.shape[1] == d:
            # the space is whole: new products of the Ritz vectors wipe out what rounding has left
            v = orthonormal(np.zeros((d, 0)), u)
            av = product(v)
            continue
        t = minres(projected, -r, 0.1 ** min(round + 1, 4), inner)
        if v.shape[1] + t.shape[1] > most and v.shape[1] > k + 4:
            keep = min(v.shape[1], k + 4)
            v, av = u[:, :keep], au[:, :keep]
        new = orthonormal(v, t)
        if not new.shape[1]:
            new = orthonormal(v, np.random.Generator(np.random.PCG64([seed, round])).normal(size=(d, 1)))
        v, av = np.column_stack([v, new]), np.column_stack([av, product(new)])
    raise ArithmeticError(f"{int((~closed).sum())} of {wanted} components have not come down to double precision in {outer} rounds")


def centred(x: np.ndarray, near: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - near).astype(np.float64) - rest


def fit_whitening(rows: DataFrame, k: int, **options) -> Fit | None:
    """Components of the rows of ``gridded``; None where there is no row or no variance."""
    n, sums = exact_sums(rows)
    if not n:
        return None
    d = len(sums)
    start = Fit(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)), 0.0)
    near, rest = start.centre

    def variances(x: np.ndarray) -> np.ndarray:
        c = centred(x, near, rest)
        return (c * c).sum(0)

    trace = float(summed(rows, variances, (d,)).sum() / n)
    if not trace > 0:
        return None

    def product(v: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            c = centred(x, near, rest)
            return c.T @ (c @ v)

        return summed(rows, work, v.shape) / n

    values, vectors = jacobi_davidson(product, d, min(k, d), trace, **options)
    # directions without variance: rounding leaves them a value near nothing
    real = values > d * 16 * EPS * values[0]
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    residual = float(np.linalg.norm(product(vectors) - vectors * values, axis=0).max())
    return Fit(n, sums, trace, values, vectors, residual)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


def whiten(
    table: DataFrame, k: int = 32, id: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000, **options
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, residual) per row and component.

    ``deviation`` is the exact sum over dimensions of (n x - S) ** 2; ``identity_error`` the largest absolute entry of the covariance of
    ``whitened`` minus the identity, measured on the rows; ``residual`` the largest norm of V u - e u in units of the largest eigenvalue.
    """
    rows = gridded(table, id, vector, scale, shift)
    fit = fit_whitening(rows, k, **options)
    if fit is None:
        return table.sparkSession.createDataFrame([], SCHEMA)
    (near, rest), n, m = fit.centre, fit.n, len(fit.values)
    turn = fit.vectors / np.sqrt(fit.values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x, near, rest) @ turn
        return np.vstack([w.T @ w, w.sum(0)])

    both = summed(rows, moments, (m + 1, m)) / n
    error = float(np.abs(both[:m] - np.outer(both[m], both[m]) - np.eye(m)).max())
    explained, residual = fit.values / fit.trace, fit.residual / fit.values[0]
    # n x - S = n (x - near) - (S - n near): small whole numbers
    shifts = [s - n * int(c) for s, c in zip(fit.sums, near)]

    def squares(x: np.ndarray) -> np.ndarray:
        small = x - near
        bound = n * int(np.abs(small).max()) + max(map(abs, shifts))
        if bound * bound * len(shifts) < 2**63:
            away = n * small - np.array(shifts, np.int64)
            return (away * away).sum(1)
        away = n * small.astype(object) - np.array(shifts, object)
        exact = (away * away).sum(1)
        if max(exact) >= 2**63:
            raise OverflowError("a squared deviation is beyond the range of a long")
        return exact.astype(np.int64)

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 + 65_536 // m):
            if not batch.num_rows:
                continue
            x = matrix(batch, "x", np.int64)
            size, each = len(x), np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * m, n)), pa.array(squares(x)[each]), pa.array((centred(x, near, rest) @ turn).ravel()),
                    pa.array(np.tile(explained, size)), pa.array(np.full(size * m, error)), pa.array(np.full(size * m, residual)),
                ],
                names,
            )
        give_back()

    return rows.mapInArrow(run, SCHEMA)
