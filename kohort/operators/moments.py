"""Second moments of (1, x, y) per group: one pass over the data, then d x d algebra.

The sums of all folds but one are the total minus that fold, so a whole grid of
cross-validated linear models needs a single scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import list_array, matrix, sum_arrays, vector

MAX_OPEN_GROUPS = 512


@dataclass(frozen=True)
class Moments:
    """n, means and centred cross products of one set of rows."""

    n: float
    mean_x: np.ndarray
    mean_y: float
    sxx: np.ndarray
    sxy: np.ndarray
    syy: float

    @staticmethod
    def from_sums(s: np.ndarray, shift_x: np.ndarray, shift_y: float) -> Moments:
        """From the raw upper triangle of Z'Z with Z = (1, x - shift_x, y - shift_y)."""
        size = int((np.sqrt(8 * len(s) + 1) - 1) / 2)
        z = np.zeros((size, size))
        z[np.triu_indices(size)] = s
        z = z + np.triu(z, 1).T
        n = z[0, 0]
        if n == 0:
            return Moments(0.0, shift_x, shift_y, z[1:-1, 1:-1], z[1:-1, -1], 0.0)
        mx, my = z[0, 1:-1] / n, z[0, -1] / n
        return Moments(
            n,
            mx + shift_x,
            my + shift_y,
            z[1:-1, 1:-1] - n * np.outer(mx, mx),
            z[1:-1, -1] - n * mx * my,
            z[-1, -1] - n * my * my,
        )

    def merge(self, other: Moments, sign: int = 1) -> Moments:
        """Moments of the union (sign 1) or of the rest (sign -1)."""
        n = self.n + sign * other.n
        if n <= 0:
            return Moments(0.0, self.mean_x, self.mean_y, self.sxx * 0, self.sxy * 0, 0.0)
        dx, dy = other.mean_x - self.mean_x, other.mean_y - self.mean_y
        share = sign * other.n / n
        cross = sign * self.n * other.n / n
        return Moments(
            n,
            self.mean_x + share * dx,
            self.mean_y + share * dy,
            self.sxx + sign * other.sxx + cross * np.outer(dx, dx),
            self.sxy + sign * other.sxy + cross * dx * dy,
            self.syy + sign * other.syy + cross * dy * dy,
        )

    def minus(self, other: Moments) -> Moments:
        return self.merge(other, -1)

    def project(self, weights: np.ndarray, center: np.ndarray | None = None) -> Moments:
        """Moments of (x - center) @ weights."""
        center = np.zeros_like(self.mean_x) if center is None else center
        return Moments(
            self.n,
            (self.mean_x - center) @ weights,
            self.mean_y,
            weights.T @ self.sxx @ weights,
            weights.T @ self.sxy,
            self.syy,
        )

    def pick(self, columns: np.ndarray) -> Moments:
        return Moments(
            self.n, self.mean_x[columns], self.mean_y, self.sxx[np.ix_(columns, columns)], self.sxy[columns], self.syy
        )

    def raw(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Uncentred X'X, X'y, sums of x, y'y."""
        return (
            self.sxx + self.n * np.outer(self.mean_x, self.mean_x),
            self.sxy + self.n * self.mean_x * self.mean_y,
            self.n * self.mean_x,
            self.syy + self.n * self.mean_y**2,
        )

    def squared_error(self, intercept: float, coef: np.ndarray) -> float:
        """Sum over the rows of (y - intercept - x'coef)^2."""
        bias = self.mean_y - intercept - self.mean_x @ coef
        return float(self.syy - 2 * coef @ self.sxy + coef @ self.sxx @ coef + self.n * bias**2)


def sums_schema(df: DataFrame, by: list[str]) -> str:
    keys = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
    return ", ".join([*keys, "s array<double>"])


def moment_sums(
    df: DataFrame,
    by: list[str] | None = None,
    x: str = "x",
    y: str = "age",
    shift: tuple[np.ndarray, float] | None = None,
) -> DataFrame:
    """Upper triangle of Z'Z, Z = (1, x, y) about ``shift``, one row per group.

    A hot group costs no more than any other: each task adds up its own rows and only
    the sums are shuffled.
    """
    by = by or []

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in sums], key_types[i]) for i in range(len(by))]
            batch = pa.RecordBatch.from_arrays([*columns, list_array(np.stack(list(sums.values())))], names=[*by, "s"])
            sums.clear()
            return batch

        for batch in batches:
            if batch.num_rows == 0:
                continue
            features, target = matrix(batch, "x"), vector(batch, "y")
            if shift is not None:
                features, target = features - shift[0], target - shift[1]
            z = np.column_stack([np.ones(len(target)), features, target])
            upper = np.triu_indices(z.shape[1])
            key_types = [batch.schema.field(c).type for c in by]
            if by:
                keys = pd.DataFrame({c: batch.column(c).to_pandas() for c in by})
                groups = keys.groupby(by, sort=False, dropna=False).indices
            else:
                groups = {(): slice(None)}
            for key, rows in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                part = z[rows]
                added = (part.T @ part)[upper]
                sums[key] = sums[key] + added if key in sums else added
            if len(sums) >= MAX_OPEN_GROUPS:
                yield flush()
        if sums:
            yield flush()

    rows = df.select(*by, F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.where("x IS NOT NULL AND y IS NOT NULL")
    return sum_arrays(rows.mapInArrow(partial, sums_schema(df, by)), "s", by)


def first_row_shift(df: DataFrame, x: str = "x", y: str = "age") -> tuple[np.ndarray, float]:
    """Some row of the data: subtracting it keeps sums of squares free of cancellation."""
    row = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).first()
    if row is None:
        raise ValueError("no rows with features and target")
    return np.asarray(row[0], dtype=float), float(row[1])


def collect_moments(df: DataFrame, by: list[str] | None = None, x: str = "x", y: str = "age") -> dict[tuple, Moments]:
    """Moments per group on the driver; meant for folds and sites, not for open-ended keys."""
    by = by or []
    shift = first_row_shift(df, x, y)
    rows = moment_sums(df, by, x, y, shift).collect()
    return {tuple(r[c] for c in by): Moments.from_sums(np.asarray(r["s"]), *shift) for r in rows}


def total(parts: dict[tuple, Moments]) -> Moments:
    parts = list(parts.values())
    out = parts[0]
    for part in parts[1:]:
        out = out.merge(part)
    return out


def cross_products(df: DataFrame, by: list[str], x: str = "x", y: str = "age") -> DataFrame:
    """``moment_sums`` in long form: (by, i, j, value), index 0 being the constant and d+1 the target."""
    sums = moment_sums(df, by, x, y)
    size = ((F.sqrt(8 * F.size("s") + 1) - 1) / 2).cast("int")
    pairs = sums.select(*by, "s", size.alias("p")).select(*by, "s", "p", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"))
    # row i of the triangle starts at i*p - i*(i-1)/2
    start = (F.col("i") * F.col("p") - F.col("i") * (F.col("i") - 1) / 2).cast("int")
    line = F.slice("s", start + 1, F.col("p") - F.col("i"))
    return pairs.select(*by, "i", F.posexplode(line).alias("o", "value")).select(
        *by, "i", (F.col("i") + F.col("o")).alias("j"), "value"
    )
