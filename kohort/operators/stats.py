"""Cohort statistics, distributions and error summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import abs_error
from .arrays import list_array, matrix, sum_arrays
from .digits import column_quantiles
from .ranks import rank_table


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def summary_stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("sd"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )


def describe_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample sd, min, exact quartiles and max of every column; NULL and NaN count as missing."""
    doubles = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(str(i)) for i, c in enumerate(columns)])
    measures = {"count": F.count, "mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    simple = doubles.agg(
        F.array(*[F.struct(F.lit(i).alias("i"), *[m(f"`{i}`").alias(n) for n, m in measures.items()]) for i in range(len(columns))]).alias("m")
    )
    quartiles = column_quantiles(doubles.select(F.array(*[F.col(f"`{i}`") for i in range(len(columns))]).alias("x")), [0.25, 0.5, 0.75])[0]
    rows = [(c, *(None if np.isnan(v) else float(v) for v in q)) for c, q in zip(columns, quartiles, strict=True)] if len(quartiles) else []
    named = F.lit([c for c in columns])[F.col("m.i")].alias("column")
    simple = simple.select(F.explode("m").alias("m")).select(named, "m.*").drop("i")
    found = df.sparkSession.createDataFrame(rows, "column string, q25 double, q50 double, q75 double")
    return simple.where("count > 0").join(found, "column", "left")


def null_counts(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "nulls")


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations in long form, both triangles and the diagonal.

    One pass: with M the presence mask and X the values (missing as 0), X'X, X'M, (X^2)'M
    and M'M hold every pair's sums, so no pair needs an aggregate of its own.
    """
    d = len(columns)
    values = F.expr("array(" + ", ".join(f"coalesce(CAST(`{c}` AS DOUBLE), double('NaN'))" for c in columns) + ")")
    # some row: subtracting it keeps the sums free of cancellation
    head = df.selectExpr(*[f"CAST(`{c}` AS DOUBLE)" for c in columns]).first() or [None] * d
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in head])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, d, d))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch, "x") - shift
            present = (~np.isnan(x)).astype(float)
            x = np.where(present > 0, x, 0.0)
            sums += np.stack([present.T @ present, x.T @ present, (x * x).T @ present, x.T @ x])
        yield pa.RecordBatch.from_arrays([list_array(sums.reshape(1, -1))], names=["s"])

    partials = df.select(values.alias("x")).mapInArrow(partial, "s array<double>")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in matrix(batch, "s"):
                n, sx, sxx, sxy = row.reshape(4, d, d)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cov = sxy - sx * sx.T / n
                    var = sxx - sx * sx / n
                    r = cov / np.sqrt(var * var.T)
                a, b = np.divmod(np.arange(d * d), d)
                names = np.array(columns, dtype=object)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[a], pa.string()), pa.array(names[b], pa.string()),
                     pa.array(r.ravel(), from_pandas=True)],
                    names=["column_a", "column_b", "r"],
                )

    return sum_arrays(partials, "s").mapInArrow(finish, "column_a string, column_b string, r double")


def top_k_correlated(correlations: DataFrame, column: str, k: int = 50) -> DataFrame:
    mine = correlations.where((F.col("column_a") == column) & F.col("r").isNotNull())
    return mine.select(F.col("column_b").alias("column"), "r").orderBy(F.desc("r"), "column").limit(k)


def _with_extent(df: DataFrame, column: str) -> DataFrame:
    extent = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("e"))
    return df.withColumn("_e", extent.scalar())


def bin_index(value: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """Equal-width bin on [lo, hi]; the last bin is closed."""
    return F.least(F.floor((value - lo) / (hi - lo) * bins), bins - 1).cast("int")


def histogram(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Counts in int(max - min) equal bins over the whole column's range."""
    by = by or []
    ranged = _with_extent(df.where(F.col(column).isNotNull()), column)
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    bins = F.greatest((hi - lo).cast("int"), F.lit(1))
    binned = ranged.select(*by, bin_index(F.col(column), lo, hi, bins).alias("bin"))
    return binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))


def site_age_range(df: DataFrame, sites: DataFrame) -> DataFrame:
    """min and max age of every listed site, NULL for a site without subjects."""
    ranges = df.groupBy("site").agg(F.min("age").alias("min_age"), F.max("age").alias("max_age"))
    return sites.join(ranges, "site", "left")


def mae_per_fold(predictions: DataFrame, fold: str = "fold") -> DataFrame:
    return predictions.groupBy(fold).agg(
        F.avg(abs_error(F.col("age"), F.col("prediction"))).alias("mae"), F.count("*").alias("n")
    )


def fold_summary(fold_mae: DataFrame) -> DataFrame:
    """Mean and population sd over folds."""
    return fold_mae.agg(F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_sd"))


def mae_per_site(predictions: DataFrame, models: list[str]) -> DataFrame:
    """Per site: number of subjects and the MAE of each model, side by side."""
    error = abs_error(F.col("age"), F.col("prediction"))
    return predictions.groupBy("site").agg(
        F.count("*").alias("n"),
        *[F.avg(F.when(F.col("model") == m, error)).alias(f"mae_{m}") for m in models],
    )


def median_across_models(wide: DataFrame, models: list[str]) -> DataFrame:
    """Median over one row's model columns; a sort inside the row, no shuffle."""
    ordered = F.array_sort(F.array(*models))
    n = len(models)
    median = (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2
    return wide.withColumn("median_error", median)


def uncertainty(used: DataFrame) -> DataFrame:
    """Population sd of the unclipped predictions of each subject."""
    return used.groupBy("subject_id").agg(F.stddev_pop("prediction").alias("uncertainty"))


def spearman_bias(predictions: DataFrame) -> DataFrame:
    """Spearman correlation of (age - prediction) with age."""
    rows = predictions.select("age", (F.col("age") - F.col("prediction")).alias("residual"))
    rows = rows.where("age IS NOT NULL AND residual IS NOT NULL")
    ranks = [rank_table(rows, "age", "rank_age"), rank_table(rows, "residual", "rank_residual")]
    ranked = rows.join(ranks[0], "age").join(ranks[1], "residual")
    return ranked.agg(F.corr("rank_residual", "rank_age").alias("rho"), F.count("*").alias("n"))


def fit_line(predictions: DataFrame, x: str = "age", y: str = "prediction") -> DataFrame:
    return predictions.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def slice_profiles(volumes: DataFrame, shape: tuple[int, int, int], pad: int | None = None) -> DataFrame:
    """Mean density of each slice along each axis, padded with 0 to the longest axis.

    Works inside one row, so a grid is never exploded or shuffled: the result is one
    array of profiles per subject and axis.
    """
    pad = pad or max(shape)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            grids = matrix(batch, "x").reshape(-1, *shape)
            out = np.zeros((len(grids), 3, pad))
            for axis in range(3):
                others = tuple(a + 1 for a in range(3) if a != axis)
                out[:, axis, : shape[axis]] = grids.mean(axis=others)
            ids = batch.column("subject_id").to_pandas().repeat(3)
            axes = np.tile(np.arange(3, dtype=np.int32), len(grids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(axes), list_array(out.reshape(-1, pad))], names=["subject_id", "axis", "profile"]
            )

    return volumes.select("subject_id", "x").mapInArrow(profile, "subject_id string, axis int, profile array<double>")


def balanced_accuracy(labels: DataFrame, truth: str = "label", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean recall of the classes, per group of the columns ``by``."""
    recall = labels.groupBy(*by, truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("recall"))
    return recall.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"), F.count("*").alias("classes"))


def class_weights(df: DataFrame, label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """n / (classes * count) per class, within each group of the columns ``by``."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    if by:
        group = Window.partitionBy(*by)
        return counts.withColumn("weight", F.sum("n").over(group) / F.count("*").over(group) / F.col("n"))
    whole = counts.agg((F.sum("n") / F.count("*")).alias("w"))
    return counts.withColumn("weight", whole.scalar() / F.col("n"))


def generation_stats(candidates: DataFrame) -> DataFrame:
    """Per generation: evaluated, invalid (-inf), and mean, population sd, min, max of finite scores."""
    invalid = F.col("score") == F.lit(float("-inf"))
    finite = F.when(~invalid, F.col("score"))
    return candidates.groupBy("generation").agg(
        F.count("*").alias("n"),
        F.count_if(invalid).alias("n_invalid"),
        F.avg(finite).alias("avg"),
        F.stddev_pop(finite).alias("std"),
        F.min(finite).alias("min"),
        F.max(finite).alias("max"),
    )
