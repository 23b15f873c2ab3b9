"""Blending model predictions into one age per subject, and reports on their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import abs_error, clip_to_range, round_half_even, weight_from_mae
from ..operators.linkage import common_subjects, exactly_one_match, lookup_model_error, lookup_site_range, require_model_errors
from ..operators.stats import median_across_models
from ..session import settle


def ensemble(
    subjects: DataFrame,
    predictions: DataFrame,
    errors: DataFrame,
    ranges: DataFrame,
    gate: float | None = 7.0,
    excluded: tuple[int, str] | None = None,
) -> DataFrame:
    """One row per subject: weighted, clipped and rounded age with its uncertainty.

    ``subjects(subject_id, site)``, ``predictions(subject_id, model, prediction)``,
    ``errors(model, mae)``, ``ranges(site, min_age, max_age)``. A model counts for a subject
    only if it has exactly one row there, its MAE passes the gate and (site, model) is not
    the excluded pair. Subjects without any model keep NULL.

    Every prediction is reduced to its weight and two sums before subjects are joined, so
    the wide side never meets more than one row per subject.
    """
    require_model_errors(predictions, errors)
    used = lookup_model_error(exactly_one_match(predictions), errors)
    used = used.withColumn("weight", weight_from_mae(F.col("mae"), gate)).where("weight IS NOT NULL")
    placed = lookup_site_range(subjects.select("subject_id", "site"), ranges)
    rows = placed.join(used, "subject_id", "left")
    if excluded:
        site, model = excluded
        keep = ~((F.col("site") == site) & (F.col("model") == model))
        kept = F.when(F.coalesce(keep, F.lit(True)), F.col("weight"))
    else:
        kept = F.col("weight")
    rows = rows.withColumn("weight", kept)
    clipped = clip_to_range(F.col("prediction"), F.col("min_age"), F.col("max_age"))
    blended = rows.groupBy("subject_id", "site", "min_age", "max_age").agg(
        F.sum(F.col("weight") * clipped).alias("weighted"),
        F.sum(F.when(clipped.isNotNull(), F.col("weight"))).alias("weights"),
        F.stddev_pop(F.when(F.col("weight").isNotNull(), F.col("prediction"))).alias("uncertainty"),
        F.count("weight").cast("int").alias("n_models"),
    )
    mean = F.when(F.col("weights") != 0, F.col("weighted") / F.col("weights"))
    final = clip_to_range(mean, F.col("min_age"), F.col("max_age"))
    return blended.select("subject_id", "site", round_half_even(final).alias("age"), "uncertainty", "n_models")


def bias_lines(train: DataFrame) -> DataFrame:
    """Per model: line of (prediction - age) on age."""
    bias = F.col("prediction") - F.col("age")
    return train.groupBy("model").agg(
        F.regr_slope(bias, F.col("age")).alias("slope"), F.regr_intercept(bias, F.col("age")).alias("intercept")
    )


def bias_correct(train: DataFrame, test: DataFrame) -> DataFrame:
    """Subtract each model's fitted bias, evaluated at the prediction itself; NULL for a model without training rows."""
    corrected = F.col("prediction") - (F.col("intercept") + F.col("slope") * F.col("prediction"))
    return test.join(settle(bias_lines(train)), "model", "left").withColumn("prediction", corrected).drop("slope", "intercept")


def ensemble_bias_corrected(
    subjects: DataFrame, train: DataFrame, test: DataFrame, errors: DataFrame, ranges: DataFrame
) -> DataFrame:
    """The ensemble on corrected predictions, without gate and exclusion: (subject_id, age)."""
    corrected = bias_correct(train, test.select("subject_id", "model", "prediction"))
    return ensemble(subjects, corrected, errors, ranges, gate=None).select("subject_id", "age")


def compare_models(predictions: DataFrame, models: list[str]) -> DataFrame:
    """Error of every model per subject and their median, worst subjects first."""
    errors = predictions.select(
        "subject_id", "model", abs_error(F.col("age"), F.col("prediction")).alias("error")
    )
    wide = median_across_models(common_subjects(errors, models), models)
    return wide.orderBy(F.desc("median_error"), "subject_id")
