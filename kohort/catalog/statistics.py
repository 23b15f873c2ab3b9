"""Aggregations and statistics."""

from pyspark.sql import functions as F

from ..operators import linkage, stats
from ..functions import scalars as S
from ..session import cut_lineage
from . import views as V
from .registry import query


@query("value_counts", "SELECT gender, count(*) AS n FROM cohort GROUP BY gender", "cohort")
def value_counts(spark, d):
    return stats.value_counts(V.cohort(spark, d), "gender")


@query(
    "summary_stats",
    """SELECT round(avg(age), 6) AS mean, round(stddev_samp(age), 6) AS sd, round(min(age), 6) AS min, round(max(age), 6) AS max
       FROM cohort""",
    "cohort",
)
def summary_stats(spark, d):
    out = stats.summary_stats(V.cohort(spark, d), "age")
    return out.select(*[V.r6(c, c) for c in out.columns])


X_COLUMNS = [f"x{i}" for i in range(64)]
LONG_X = """SELECT 'x' || p AS "column", CAST(embedding[p + 1] AS DOUBLE) AS value
    FROM embeddings, (SELECT range AS p FROM range(64)) UNION ALL SELECT 'age', age FROM features"""


def wide_features(spark, d):
    f = V.features(spark, d)
    return f.selectExpr("age", *[f"x[{i}] AS x{i}" for i in range(64)])


@query(
    "describe_all",
    """SELECT "column", count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
       round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
       round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM long_x GROUP BY "column" """,
    "features",
    extra={"long_x": LONG_X},
)
def describe_all(spark, d):
    out = stats.describe_all(wide_features(spark, d), ["age", *X_COLUMNS])
    return out.select("column", "count", *[V.r6(c, c) for c in ("mean", "sd", "min", "q25", "q50", "q75", "max")])


def demographics_of_imaged(spark, d):
    imaged = V.features(spark, d).select("subject_id", F.col("x")[0].alias("x0"))
    return linkage.join_demographics_right(V.cohort(spark, d), imaged)


IMAGED = "SELECT f.subject_id, c.age, c.gender, c.site, f.x[1] AS x0 FROM cohort c RIGHT JOIN features f ON c.subject_id = f.subject_id"
NULL_COLUMNS = ["subject_id", "age", "gender", "site", "x0"]


@query(
    "null_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls FROM imaged""" for c in NULL_COLUMNS
    ),
    "cohort",
    "features",
    extra={"imaged": IMAGED},
)
def null_counts(spark, d):
    return stats.null_counts(demographics_of_imaged(spark, d).select(*NULL_COLUMNS))


# every eleventh subject lacks x3, so that pairs differ in their complete rows
GAPPED = ["age", "x0", "x1", "x2", "x3", "x4", "x5", "x6", "x7"]


def gapped(spark, d):
    f = V.features(spark, d)
    columns = [F.col("x")[i].alias(f"x{i}") for i in range(8) if i != 3]
    return f.select("age", F.when(F.col("position") % 11 != 0, F.col("x")[3]).alias("x3"), *columns)


GAPPED_SQL = "SELECT age, " + ", ".join(
    f"CASE WHEN position % 11 <> 0 THEN x[{i + 1}] END AS x{i}" if i == 3 else f"x[{i + 1}] AS x{i}" for i in range(8)
) + " FROM features"
CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM gapped" for a in GAPPED for b in GAPPED
)


@query(
    "corr_matrix",
    "SELECT column_a, column_b, round(r, 6) AS r FROM correlations",
    "features",
    extra={"gapped": GAPPED_SQL, "correlations": CORR_SQL},
)
def corr_matrix(spark, d):
    return stats.corr_matrix(gapped(spark, d), GAPPED).select("column_a", "column_b", V.r6("r", "r"))


@query(
    "top_k_correlated",
    """SELECT "column", round(r, 6) AS r FROM (
         SELECT 'x' || p AS "column", corr(x[p + 1], age) AS r FROM features, (SELECT range AS p FROM range(64)) GROUP BY p
         UNION ALL SELECT 'age', corr(age, age) FROM features)
       ORDER BY r DESC, "column" LIMIT 50""",
    "features",
)
def top_k_correlated(spark, d):
    correlations = stats.corr_matrix(wide_features(spark, d), ["age", *X_COLUMNS])
    return stats.top_k_correlated(correlations, "age", 50).select("column", V.r6("r", "r"))


BINS = """SELECT site, gender, CAST(least(floor((age - lo) / (hi - lo) * CAST(trunc(hi - lo) AS INTEGER)),
    CAST(trunc(hi - lo) AS INTEGER) - 1) AS INTEGER) AS bin
    FROM cohort, (SELECT min(age) AS lo, max(age) AS hi FROM cohort)"""


@query("histogram", "SELECT bin, count(*) AS n FROM bins GROUP BY bin", "cohort", extra={"bins": BINS})
def histogram(spark, d):
    return stats.histogram(V.cohort(spark, d), "age")


@query(
    "grouped_histogram",
    "SELECT site, gender, bin, count(*) AS n FROM bins GROUP BY site, gender, bin",
    "cohort",
    extra={"bins": BINS},
)
def grouped_histogram(spark, d):
    return stats.histogram(V.cohort(spark, d), "age", ["site", "gender"])


@query("site_age_range", "SELECT site, min_age, max_age FROM site_ranges", "site_ranges")
def site_age_range(spark, d):
    return V.site_ranges(spark, d)


# folds of the prediction table: five by order number
FOLDED = "SELECT *, CAST(subject_id % 5 AS INTEGER) AS fold FROM predictions"


def folded(spark, d):
    return V.predictions(spark, d).withColumn("fold", (F.col("subject_id") % 5).cast("int"))


@query(
    "mae_per_fold",
    """SELECT fold, round(mae, 6) AS mae, n, round(avg(mae) OVER (), 6) AS mae_mean, round(stddev_pop(mae) OVER (), 6) AS mae_sd
       FROM (SELECT fold, avg(abs(age - prediction)) AS mae, count(*) AS n FROM folded GROUP BY fold)""",
    "predictions",
    extra={"folded": FOLDED},
)
def mae_per_fold(spark, d):
    per_fold = stats.mae_per_fold(folded(spark, d))
    summary = stats.fold_summary(per_fold).select(F.struct("mae_mean", "mae_sd").alias("s"))
    out = per_fold.withColumn("s", summary.scalar())
    return out.select("fold", V.r6("mae", "mae"), "n", V.r6("s.mae_mean", "mae_mean"), V.r6("s.mae_sd", "mae_sd"))


@query(
    "mae_per_site",
    "SELECT site, count(*) AS n, "
    + ", ".join(f"round(avg(CASE WHEN model = 'm{i}' THEN abs(age - prediction) END), 6) AS mae_m{i}" for i in (1, 2))
    + " FROM predictions WHERE model IN ('m1', 'm2') GROUP BY site",
    "predictions",
)
def mae_per_site(spark, d):
    two = V.predictions(spark, d).where(F.col("model").isin("m1", "m2"))
    out = stats.mae_per_site(two, ["m1", "m2"])
    return out.select("site", "n", V.r6("mae_m1", "mae_m1"), V.r6("mae_m2", "mae_m2"))


@query(
    "median_across_models",
    """SELECT subject_id, round(median_error, 6) AS median_error FROM (
         SELECT subject_id, median(error) AS median_error, count(DISTINCT model) AS models FROM (
           SELECT subject_id, model, avg(abs(age - prediction)) AS error FROM predictions
           GROUP BY subject_id, model) GROUP BY subject_id)
       WHERE models = (SELECT count(DISTINCT model) FROM predictions) ORDER BY median_error DESC, subject_id""",
    "predictions",
)
def median_across_models(spark, d):
    models = V.MODELS
    errors = V.predictions(spark, d).select(
        "subject_id", "model", S.abs_error(F.col("age"), F.col("prediction")).alias("error")
    )
    ranked = stats.median_across_models(linkage.common_subjects(errors, models), models)
    out = ranked.select("subject_id", V.r6("median_error", "median_error"))
    return out.orderBy(F.desc("median_error"), "subject_id")


@query(
    "uncertainty",
    "SELECT subject_id, round(stddev_pop(prediction), 6) AS uncertainty FROM one_each GROUP BY subject_id",
    "one_each",
)
def uncertainty(spark, d):
    used = linkage.exactly_one_match(V.test_predictions(spark, d))
    return stats.uncertainty(used).select("subject_id", V.r6("uncertainty", "uncertainty"))


@query(
    "spearman_bias",
    """SELECT round(corr(ra, rr), 6) AS rho, count(*) AS n FROM (
         SELECT rank() OVER (ORDER BY age) + (count(*) OVER (PARTITION BY age) - 1) / 2.0 AS ra,
                rank() OVER (ORDER BY residual) + (count(*) OVER (PARTITION BY residual) - 1) / 2.0 AS rr
         FROM (SELECT age, age - prediction AS residual FROM predictions))""",
    "predictions",
)
def spearman_bias(spark, d):
    # ranking reads its input several times: the joined view is written once, two columns wide
    rows = cut_lineage(V.predictions(spark, d).select("age", "prediction"))
    return stats.spearman_bias(rows).select(V.r6("rho", "rho"), "n")


@query(
    "fit_line",
    "SELECT round(regr_slope(prediction, age), 6) AS slope, round(regr_intercept(prediction, age), 6) AS intercept FROM predictions",
    "predictions",
)
def fit_line(spark, d):
    return stats.fit_line(V.predictions(spark, d)).select(V.r6("slope", "slope"), V.r6("intercept", "intercept"))


PROFILES = " UNION ALL ".join(
    f"SELECT subject_id, CAST({axis} AS INTEGER) AS axis, CAST((p // {stride}) % 4 AS INTEGER) AS slice, v FROM voxels"
    for axis, stride in enumerate((16, 4, 1))
)


@query(
    "slice_profiles",
    """SELECT subject_id, axis, slice, round(avg(v), 6) AS density FROM long_slices GROUP BY subject_id, axis, slice
       UNION ALL SELECT subject_id, CAST(a AS INTEGER), CAST(s AS INTEGER), 0.0 FROM features,
         (SELECT range AS a FROM range(3)), (SELECT range AS s FROM range(4, 6))""",
    "features",
    extra={
        "voxels": "SELECT subject_id, p, x[p + 1] AS v FROM features, (SELECT range AS p FROM range(64))",
        "long_slices": PROFILES,
    },
)
def slice_profiles(spark, d):
    profiles = stats.slice_profiles(V.features(spark, d), (4, 4, 4), pad=6)
    long = profiles.select("subject_id", "axis", F.posexplode("profile").alias("slice", "density"))
    return long.select("subject_id", "axis", "slice", V.r6("density", "density"))


LABELLED = "SELECT model, CAST(trunc(age) AS INTEGER) AS label, CAST(trunc(prediction) AS INTEGER) AS predicted FROM predictions"


def labelled(spark, d):
    return V.predictions(spark, d).select("model", S.int_label(F.col("age")).alias("label"), S.int_label(F.col("prediction")).alias("predicted"))


@query(
    "balanced_accuracy",
    """SELECT model, round(avg(recall), 6) AS balanced_accuracy, count(*) AS classes FROM (
         SELECT model, label, avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) AS recall FROM labelled GROUP BY model, label)
       GROUP BY model""",
    "predictions",
    extra={"labelled": LABELLED},
)
def balanced_accuracy(spark, d):
    out = stats.balanced_accuracy(labelled(spark, d), by=("model",))
    return out.select("model", V.r6("balanced_accuracy", "balanced_accuracy"), "classes")


@query(
    "class_weights",
    """SELECT model, label, n, round(CAST(sum(n) OVER w AS DOUBLE) / count(*) OVER w / n, 6) AS weight FROM (
         SELECT model, label, count(*) AS n FROM labelled GROUP BY model, label) WINDOW w AS (PARTITION BY model)""",
    "predictions",
    extra={"labelled": LABELLED},
)
def class_weights(spark, d):
    return stats.class_weights(labelled(spark, d), by=("model",)).select("model", "label", "n", V.r6("weight", "weight"))


FINITE = "CASE WHEN NOT isinf(score) THEN score END"


@query(
    "generation_stats",
    f"""SELECT generation, count(*) AS n, count(*) - count({FINITE}) AS n_invalid, round(avg({FINITE}), 6) AS avg,
        round(stddev_pop({FINITE}), 6) AS std, round(min({FINITE}), 6) AS min, round(max({FINITE}), 6) AS max
        FROM candidates GROUP BY generation""",
    "candidates",
)
def generation_stats(spark, d):
    out = stats.generation_stats(V.candidates(spark, d))
    return out.select("generation", "n", "n_invalid", *[V.r6(c, c) for c in ("avg", "std", "min", "max")])
