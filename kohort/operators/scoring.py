"""Applying linear models to tables: many coefficient sets in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import list_array, matrix, sum_arrays, vector
from .linear import Coefficients


def predict_column(intercept: float, coef: np.ndarray, x: str = "x") -> Column:
    from ..functions.scalars import dot

    return dot(F.col(x), F.lit([float(c) for c in coef])) + F.lit(float(intercept))


def coefficient_table(spark, models: dict, key: str) -> DataFrame:
    rows = [(k, float(b), [float(v) for v in w]) for k, (b, w) in models.items()]
    kind = "int" if rows and isinstance(rows[0][0], (int, np.integer)) else "string"
    return spark.createDataFrame(rows, f"{key} {kind}, intercept double, coef array<double>")


def predict_by(df: DataFrame, models: dict, key: str, x: str = "x", out: str = "prediction") -> DataFrame:
    """Each row scored by the model of its ``key`` (fold or site); rows without a model get NULL.

    One matrix product per batch and model; the coefficients travel with the task.
    """
    names = list(models)
    weights = np.column_stack([models[k][1] for k in names])
    intercepts = np.array([models[k][0] for k in names])
    levels = {k: i for i, k in enumerate(names)}
    kept = [c for c in df.columns]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + f", `{out}` double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            code = np.array([levels.get(v, -1) for v in batch.column(key).to_pylist()])
            z = matrix(batch, x) @ weights + intercepts
            value = np.where(code >= 0, z[np.arange(len(code)), np.maximum(code, 0)], np.nan)
            columns = [batch.column(c) for c in kept] + [pa.array(value, pa.float64(), from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, out])

    return df.mapInArrow(score, schema)


def absolute_errors(
    df: DataFrame, models: list[Coefficients], sets: list[int], x: str = "x", y: str = "age", member: str = "held"
) -> tuple[np.ndarray, np.ndarray]:
    """(sum of |y - prediction|, n) of every model over its own held-out rows, in one pass.

    ``member`` is an array column of 0/1 flags; model m is scored on rows whose flag
    ``sets[m]`` is 1.
    """
    weights = np.column_stack([c for _, c in models])
    intercepts = np.array([b for b, _ in models])
    which = np.asarray(sets)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(which)))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flags = matrix(batch, "flags")[:, which]
            error = np.abs(vector(batch, "y")[:, None] - matrix(batch, "x") @ weights - intercepts)
            sums[0] += (error * flags).sum(0)
            sums[1] += flags.sum(0)
        yield pa.RecordBatch.from_arrays([list_array(sums.reshape(1, -1))], names=["s"])

    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(member).cast("array<double>").alias("flags"))
    s = np.asarray(sum_arrays(rows.mapInArrow(partial, "s array<double>"), "s").first()["s"])
    return s[: len(which)], s[len(which) :]
