"""Feature preparation fitted from distributed statistics, applied as array expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import collect_sum, list_array, matrix, sum_arrays
from .digits import column_quantiles
from .folds import shuffle_key
from .linear import ols
from .moments import Moments, collect_moments, total
from .ranks import average_ranks

QUARTILES = [0.25, 0.5, 0.75]


def literal(values) -> Column:
    return F.lit([float(v) for v in values])


@dataclass(frozen=True)
class Affine:
    """x -> (x - center) @ weights: every linear preparation step in one form."""

    center: np.ndarray
    weights: np.ndarray

    def apply(self, df: DataFrame, x: str = "x") -> DataFrame:
        return map_matrix(df, lambda z: (z - self.center) @ self.weights, x)


def map_matrix(df: DataFrame, fn, x: str = "x") -> DataFrame:
    """Replace the array column by ``fn`` of its Arrow batches, seen as an (n, d) matrix."""
    kept = [c for c in df.columns if c != x]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    schema = ", ".join(s for s in (schema, f"`{x}` array<double>") if s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(c) for c in kept] + [list_array(fn(matrix(batch, x)))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, x])

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- scaling and imputation


def robust_affine(q: np.ndarray) -> Affine:
    """(x - median) / range of the quartiles ``q`` (columns x 3); a zero range scales by 1."""
    width = q[:, 2] - q[:, 0]
    return Affine(q[:, 1], np.diag(1 / np.where(width == 0, 1.0, width)))


def collect_robust(df: DataFrame, x: str = "x") -> Affine:
    return robust_affine(column_quantiles(df, QUARTILES, x)[0])


def robust_scale(df: DataFrame, fitted: Affine, x: str = "x") -> DataFrame:
    """(x - median) / range, element by element and JVM-side."""
    scale = 1 / np.diag(fitted.weights)
    shifted = F.zip_with(x, literal(fitted.center), lambda v, m: v - m)
    return df.withColumn(x, F.zip_with(shifted, literal(scale), lambda v, s: v / s))


def column_medians(df: DataFrame, x: str = "x") -> list[float]:
    return column_quantiles(df, [0.5], x)[0, :, 0].tolist()


def impute_median(df: DataFrame, medians: list[float], x: str = "x") -> DataFrame:
    return df.withColumn(x, F.zip_with(x, literal(medians), lambda v, m: F.coalesce(F.when(~F.isnan(v), v), m)))


# ---------------------------------------------------------------- selection


def column_scores(m: Moments) -> dict[str, np.ndarray]:
    """Population variance and F statistic against the target, per column."""
    variance = np.diag(m.sxx) / m.n
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = m.sxy**2 / (np.diag(m.sxx) * m.syy)
        f = r2 / (1 - r2) * (m.n - 2)
    return {"variance": variance, "f": f}


def variance_mask(m: Moments, threshold: float = 0.0) -> np.ndarray:
    return column_scores(m)["variance"] > threshold


def percentile_mask(m: Moments, percentile: float = 10) -> np.ndarray:
    """Columns above the (100 - percentile)th percentile of F; ties at it fill up in column order."""
    scores = np.nan_to_num(column_scores(m)["f"], nan=-np.inf)
    if percentile >= 100:
        return np.ones(len(scores), bool)
    cut = np.percentile(scores, 100 - percentile)
    mask = scores > cut
    room = int(len(scores) * percentile / 100) - int(mask.sum())
    mask[np.flatnonzero(scores == cut)[: max(room, 0)]] = True
    return mask


def select_columns(df: DataFrame, columns, x: str = "x") -> DataFrame:
    return df.withColumn(x, F.transform(F.lit([int(c) for c in columns]), lambda i: F.get(F.col(x), i)))


def select_fwe(df: DataFrame, alpha: float = 0.05, x: str = "x", y: str = "age") -> DataFrame:
    """Keep columns whose F-test p-value lies below alpha / d."""
    vectors = df.withColumn("_v", array_to_vector(x))
    selector = UnivariateFeatureSelector(featuresCol="_v", labelCol=y, outputCol="_s", selectionMode="fwe")
    selector.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(alpha)
    kept = sorted(selector.fit(vectors).selectedFeatures)
    return select_columns(df, kept, x)


# ---------------------------------------------------------------- projections


def fit_pca(m: Moments, components: float | int) -> tuple[Affine, np.ndarray]:
    """Centred principal axes and their variance shares; a fraction keeps the fewest axes exceeding it."""
    if components <= 0:
        raise ValueError("a projection needs at least one axis")
    values, vectors = np.linalg.eigh(m.sxx)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    share = values / values.sum() if values.sum() > 0 else values
    k = int(components) if components >= 1 else int(np.searchsorted(np.cumsum(share), components, side="right")) + 1
    axes = vectors[:, : min(k, len(values))]
    # fixed sign: the largest loading of each axis is positive
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return Affine(m.mean_x, axes), share[: axes.shape[1]]


def pca(df: DataFrame, components: float | int, x: str = "x", y: str = "age") -> DataFrame:
    return fit_pca(total(collect_moments(df, [], x, y)), components)[0].apply(df, x)


def fast_ica(
    df: DataFrame, components: int, x: str = "x", y: str = "age", tol: float = 1e-4, max_iter: int = 100, seed: int = 42
) -> tuple[DataFrame, Affine]:
    """Independent components: whitening from moments, then one aggregate per fixed-point step (tanh, symmetric)."""
    m = total(collect_moments(df, [], x, y))
    base, _ = fit_pca(m, components)
    projected = base.weights.T @ m.sxx @ base.weights / m.n
    white = Affine(base.center, base.weights / np.sqrt(np.maximum(np.diag(projected), 1e-300)))
    k = white.weights.shape[1]
    rows = df.select(F.col(x).alias("x")).persist()
    parts = rows.rdd.getNumPartitions()

    def decorrelate(w: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(w, full_matrices=False)
        return u @ v

    w = decorrelate(np.random.default_rng(seed).normal(size=(k, k)))
    try:
        for _ in range(max_iter):
            unmix = white.weights @ w.T

            def partial(batches: Iterator[pa.RecordBatch], unmix=unmix) -> Iterator[pa.RecordBatch]:
                sums = np.zeros((k + 1, k))
                for batch in batches:
                    if batch.num_rows:
                        z = matrix(batch, "x") - white.center
                        g = np.tanh(z @ unmix)
                        sums[:k] += g.T @ (z @ white.weights)
                        sums[k] += (1 - g * g).sum(0)
                yield pa.RecordBatch.from_arrays([list_array(sums.reshape(1, -1))], names=["s"])

            sums = collect_sum(rows.mapInArrow(partial, "s array<double>"), "s", parts).reshape(k + 1, k)
            new = decorrelate(sums[:k] / m.n - (sums[k] / m.n)[:, None] * w)
            moved = np.abs(np.abs((new * w).sum(1)) - 1).max()
            w = new
            if moved < tol:
                break
    finally:
        rows.unpersist()
    mixing = Affine(white.center, white.weights @ w.T)
    return mixing.apply(df, x), mixing


def rbf_features(df: DataFrame, gamma: float = 1.0, components: int = 100, seed: int = 42, x: str = "x") -> DataFrame:
    """Random Fourier features of exp(-gamma |a - b|^2)."""
    d = len(df.select(x).first()[x])
    rng = np.random.default_rng(seed)
    weights = np.sqrt(2 * gamma) * rng.normal(size=(d, components))
    offset = rng.uniform(0, 2 * np.pi, components)
    return map_matrix(df, lambda z: np.sqrt(2 / components) * np.cos(z @ weights + offset), x)


def kernel(name: str, a: np.ndarray, b: np.ndarray, gamma: float, degree: int = 3, coef0: float = 1.0) -> np.ndarray:
    """Kernel values of rows of ``a`` against landmark rows ``b``."""
    if name == "linear":
        return a @ b.T
    if name in ("poly", "polynomial"):
        return (gamma * (a @ b.T) + coef0) ** degree
    if name == "sigmoid":
        return np.tanh(gamma * (a @ b.T) + coef0)
    if name == "cosine":
        norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        return a @ b.T / np.where(norms > 0, norms, 1.0)
    if name == "rbf":
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        return np.exp(-gamma * np.maximum(square, 0))
    columns = []
    for landmark in b:
        if name == "laplacian":
            columns.append(np.exp(-gamma * np.abs(a - landmark).sum(1)))
            continue
        bottom = a + landmark
        ratio = (a - landmark) ** 2 / np.where(bottom != 0, bottom, 1.0)
        distance = -np.where(bottom != 0, ratio, 0.0).sum(1)
        columns.append(distance if name == "additive_chi2" else np.exp(gamma * distance))
    return np.column_stack(columns)


def nystroem(
    df: DataFrame, name: str = "rbf", gamma: float = 1.0, components: int = 10, seed: int = 42,
    x: str = "x", id_col: str = "subject_id",
) -> DataFrame:
    """Kernel features against the ``components`` rows that come first in seeded hash order."""
    picked = df.select(x, shuffle_key(F.col(id_col), seed).alias("_k"), id_col).orderBy("_k", id_col).limit(components)
    landmarks = np.array([r[x] for r in picked.collect()])
    u, s, v = np.linalg.svd(kernel(name, landmarks, landmarks, gamma))
    root = (u / np.sqrt(np.maximum(s, 1e-12))) @ v
    return map_matrix(df, lambda z: kernel(name, z, landmarks, gamma) @ root.T, x)


# ---------------------------------------------------------------- agglomeration


def column_distances(df: DataFrame, m: Moments, affinity: str, x: str = "x") -> np.ndarray:
    """Distances between columns: from moments, or one pass of absolute differences for l1."""
    xx = m.raw()[0]
    norms = np.diag(xx)
    if affinity in ("euclidean", "l2"):
        return np.sqrt(np.maximum(norms[:, None] + norms[None, :] - 2 * xx, 0))
    if affinity == "cosine":
        scale = np.sqrt(np.outer(norms, norms))
        return 1 - xx / np.where(scale > 0, scale, 1.0)
    d = len(norms)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                z = matrix(batch, "x")
                for j in range(d):
                    sums[j] += np.abs(z - z[:, [j]]).sum(0)
        yield pa.RecordBatch.from_arrays([list_array(sums.reshape(1, -1))], names=["s"])

    rows = df.select(F.col(x).alias("x")).mapInArrow(partial, "s array<double>")
    return np.asarray(sum_arrays(rows, "s").first()["s"]).reshape(d, d)


def merge_columns(distance: np.ndarray, clusters: int, linkage: str = "ward") -> np.ndarray:
    """Group number of every column after agglomerative merging on d x d distances."""
    d = len(distance)
    work = distance**2 if linkage == "ward" else distance.copy()
    np.fill_diagonal(work, np.inf)
    size, groups = np.ones(d), {i: [i] for i in range(d)}
    while len(groups) > clusters:
        live = sorted(groups)
        sub = work[np.ix_(live, live)]
        i, j = divmod(int(sub.argmin()), len(live))
        a, b = sorted((live[i], live[j]))
        others = [c for c in live if c not in (a, b)]
        if linkage == "ward":
            n = size[a] + size[b] + size[others]
            joined = ((size[a] + size[others]) * work[a, others] + (size[b] + size[others]) * work[b, others]
                      - size[others] * work[a, b]) / n
        elif linkage == "complete":
            joined = np.maximum(work[a, others], work[b, others])
        else:
            joined = (size[a] * work[a, others] + size[b] * work[b, others]) / (size[a] + size[b])
        work[a, others] = work[others, a] = joined
        size[a] += size[b]
        groups[a] += groups.pop(b)
    label = np.zeros(d, int)
    for number, key in enumerate(sorted(groups)):
        label[groups[key]] = number
    return label


def feature_agglomeration(
    df: DataFrame, clusters: int = 2, linkage: str = "ward", affinity: str = "euclidean", x: str = "x", y: str = "age"
) -> DataFrame:
    """Similar columns merged; the array becomes the group means."""
    m = total(collect_moments(df, [], x, y))
    label = merge_columns(column_distances(df, m, affinity, x), clusters, linkage)
    weights = (label[:, None] == np.arange(label.max() + 1)[None, :]).astype(float)
    return Affine(np.zeros(len(label)), weights / weights.sum(0)).apply(df, x)


# ---------------------------------------------------------------- rows and stacking


def stack_feature(df: DataFrame, fitted=None, x: str = "x", y: str = "age") -> DataFrame:
    """(prediction, x, x): a least-squares prediction in front, united with an untouched copy.

    Without ``fitted`` the model is fitted on the rows it predicts; pass coefficients of
    other folds for the out-of-fold form.
    """
    intercept, coef = fitted or ols(total(collect_moments(df, [], x, y)))
    return map_matrix(df, lambda z: np.column_stack([z @ coef + intercept, z, z]), x)


def oversample_minority(df: DataFrame, label: str = "label", id_col: str = "subject_id", seed: int = 0) -> DataFrame:
    """Add random copies of the smallest class until it equals the largest; copies carry ``copy`` > 0."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    small = counts.orderBy("n", label).limit(1).first()
    most = counts.agg(F.max("n")).first()[0]
    extra = most - small["n"]
    minority = df.where(F.col(label) == small[label]).withColumn("_k", shuffle_key(F.col(id_col), seed))
    # copies of an id share their key and its mean rank; they are numbered around it
    ties = Window.partitionBy("_k")
    among = F.row_number().over(ties.orderBy(id_col)) - (F.count("*").over(ties) + 1) / 2
    numbered = average_ranks(minority, "_k", "_r").withColumn("_j", F.round(F.col("_r") + among).cast("bigint")).drop("_k", "_r")
    # draw i takes minority row number hash(i) mod n
    draw = F.pmod(shuffle_key(F.col("id"), seed).cast("bigint"), F.lit(small["n"])) + 1
    draws = df.sparkSession.range(extra).select(draw.alias("_j"), (F.col("id") + 1).alias("copy"))
    copies = numbered.join(draws, "_j").drop("_j")
    return df.withColumn("copy", F.lit(0).cast("bigint")).unionByName(copies)
