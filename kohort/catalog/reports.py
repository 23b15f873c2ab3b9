"""Ensembles and model comparison."""

from pyspark.sql import functions as F

from ..plans import ensemble as E
from . import views as V
from .registry import query

BLEND = """SELECT s.subject_id, s.site,
    CASE WHEN w.total IS NOT NULL AND r.min_age IS NOT NULL THEN
      CAST(round_even(least(greatest(w.total / w.weights, r.min_age), r.max_age), 0) AS INTEGER) END AS age,
    round(w.uncertainty, 6) AS uncertainty, CAST(coalesce(w.n_models, 0) AS INTEGER) AS n_models
  FROM (SELECT * FROM subjects WHERE NOT is_train) s LEFT JOIN site_ranges r ON s.site = r.site
  LEFT JOIN (SELECT subject_id, sum(weight * clipped) AS total, sum(CASE WHEN clipped IS NOT NULL THEN weight END) AS weights,
               stddev_pop(prediction) AS uncertainty, count(*) AS n_models FROM weighted GROUP BY subject_id) w
    ON w.subject_id = s.subject_id"""
WEIGHTED = """SELECT o.subject_id, o.prediction, (7 - e.mae) * (7 - e.mae) AS weight,
    CASE WHEN r.min_age IS NOT NULL THEN least(greatest(o.prediction, r.min_age), r.max_age) END AS clipped
  FROM {source} o JOIN model_errors e ON o.model = e.model JOIN subjects s ON s.subject_id = o.subject_id
  LEFT JOIN site_ranges r ON r.site = s.site"""
EXCLUDED = (14, "m3")


def test_subjects(spark, d):
    return V.subjects(spark, d).where("NOT is_train").select("subject_id", "site")


@query(
    "ensemble",
    BLEND,
    "one_each",
    "model_errors",
    "site_ranges",
    extra={"weighted": WEIGHTED.format(source="one_each") + " WHERE e.mae < 7 AND NOT (s.site = 14 AND o.model = 'm3')"},
)
def ensemble(spark, d):
    out = E.ensemble(
        test_subjects(spark, d),
        V.test_predictions(spark, d),
        V.model_errors(spark, d),
        V.site_ranges(spark, d),
        excluded=EXCLUDED,
    )
    return out.withColumn("uncertainty", F.round("uncertainty", 6))


BIAS = """SELECT model, regr_slope(prediction - age, age) AS slope, regr_intercept(prediction - age, age) AS intercept
    FROM predictions WHERE is_train GROUP BY model"""
CORRECTED = """SELECT o.subject_id, o.model, o.prediction - (b.intercept + b.slope * o.prediction) AS prediction
    FROM one_each o JOIN bias b ON o.model = b.model"""


@query(
    "bias_correct",
    """SELECT p.subject_id, p.model, round(p.prediction - (b.intercept + b.slope * p.prediction), 6) AS prediction
       FROM predictions p JOIN bias b ON p.model = b.model WHERE NOT p.is_train""",
    "predictions",
    extra={"bias": BIAS},
)
def bias_correct(spark, d):
    test = V.test_predictions(spark, d).select("subject_id", "model", "prediction")
    out = E.bias_correct(V.train_predictions(spark, d), test)
    return out.select("subject_id", "model", V.r6("prediction", "prediction"))


@query(
    "ensemble_bias_corrected",
    f"SELECT subject_id, age FROM ({BLEND})",
    "one_each",
    "model_errors",
    "site_ranges",
    extra={"bias": BIAS, "corrected": CORRECTED, "weighted": WEIGHTED.format(source="corrected")},
)
def ensemble_bias_corrected(spark, d):
    return E.ensemble_bias_corrected(
        test_subjects(spark, d),
        V.train_predictions(spark, d),
        V.test_predictions(spark, d),
        V.model_errors(spark, d),
        V.site_ranges(spark, d),
    )


@query(
    "compare_models",
    f"""SELECT subject_id, {", ".join(f"round(m{i}, 6) AS m{i}" for i in range(1, 8))},
        round(list_median, 6) AS median_error FROM (
          SELECT *, list_aggregate([{", ".join(f"m{i}" for i in range(1, 8))}], 'median') AS list_median FROM wide)
        WHERE {" AND ".join(f"m{i} IS NOT NULL" for i in range(1, 8))} ORDER BY median_error DESC, subject_id""",
    "predictions",
    extra={
        "wide": "SELECT subject_id, "
        + ", ".join(f"avg(CASE WHEN model = 'm{i}' THEN abs(age - prediction) END) AS m{i}" for i in range(1, 8))
        + " FROM predictions GROUP BY subject_id"
    },
)
def compare_models(spark, d):
    out = E.compare_models(V.predictions(spark, d), V.MODELS)
    return out.select("subject_id", *[V.r6(c, c) for c in (*V.MODELS, "median_error")])
