"""Feature preparation."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import features as prep
from ..operators import moments
from . import views as V
from .registry import query

LONG = """SELECT subject_id, p AS "column", x[p + 1] AS value FROM features, (SELECT CAST(range AS INTEGER) AS p FROM range(64))"""


@query(
    "robust_scale",
    """SELECT l.subject_id, l."column", round((l.value - q.m) / CASE WHEN q.w = 0 THEN 1 ELSE q.w END, 6) AS value
       FROM long_x l JOIN (SELECT "column", quantile_cont(value, 0.5) AS m,
         quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS w FROM long_x
         WHERE subject_id IN (SELECT subject_id FROM features WHERE position % 5 <> 0) GROUP BY "column") q
       ON l."column" = q."column" """,
    "features",
    extra={"long_x": LONG},
)
def robust_scale(spark, d):
    f = V.features(spark, d)
    fitted = prep.collect_robust(f.where("position % 5 <> 0"))
    scaled = prep.robust_scale(f, fitted)
    long = scaled.select("subject_id", F.posexplode("x").alias("column", "value"))
    return long.select("subject_id", "column", V.r6("value", "value"))


@query("pca")
def pca(spark, d):
    out = prep.pca(V.features(spark, d), 0.9)
    return out.select("subject_id", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


GAPS = """SELECT subject_id, p AS "column", CASE WHEN (position + p) % 13 <> 0 THEN x[p + 1] END AS value
    FROM features, (SELECT CAST(range AS INTEGER) AS p FROM range(64))"""


@query(
    "impute_median",
    """SELECT subject_id, g."column", round(coalesce(value, m), 6) AS value FROM gaps g JOIN
       (SELECT "column", median(value) AS m FROM gaps GROUP BY "column") q ON g."column" = q."column" """,
    "features",
    extra={"gaps": GAPS},
)
def impute_median(spark, d):
    gaps = V.features(spark, d).withColumn(
        "x", F.transform("x", lambda v, p: F.when((F.col("position") + p) % 13 != 0, v))
    )
    filled = prep.impute_median(gaps, prep.column_medians(gaps))
    long = filled.select("subject_id", F.posexplode("x").alias("column", "value"))
    return long.select("subject_id", "column", V.r6("value", "value"))


HASH = "CAST('0x' || substr(md5('0:' || {}), 1, 13) AS BIGINT)"


@query(
    "oversample_minority",
    f"""SELECT subject_id, label, age, CAST(0 AS BIGINT) AS copy FROM labelled UNION ALL
        SELECT m.subject_id, m.label, m.age, i + 1 AS copy FROM
          (SELECT *, row_number() OVER (ORDER BY {HASH.format("subject_id")}) - 1 AS j FROM labelled
           WHERE label = (SELECT label FROM counts ORDER BY n, label LIMIT 1)) m
        JOIN (SELECT range AS i, {HASH.format("range")} % (SELECT min(n) FROM counts) AS j
              FROM range((SELECT max(n) - min(n) FROM counts))) d ON d.j = m.j""",
    "features",
    extra={
        "labelled": "SELECT subject_id, site AS label, age FROM features",
        "counts": "SELECT label, count(*) AS n FROM labelled GROUP BY label",
    },
)
def oversample_minority(spark, d):
    labelled = V.features(spark, d).withColumn("label", F.col("site")).select("subject_id", "label", "age")
    return prep.oversample_minority(labelled)


def all_moments(spark, d):
    return moments.total(moments.collect_moments(V.features(spark, d)))


def column_table(spark, names, **columns):
    rows = [(int(j), *[float(v[j]) for v in columns.values()]) for j in names]
    schema = ", ".join(["`column` int", *[f"{c} double" for c in columns]])
    return spark.createDataFrame(rows, schema)


STATS = """SELECT "column", var_pop(value) AS variance,
    pow(corr(value, age), 2) / (1 - pow(corr(value, age), 2)) * (count(*) - 2) AS f
    FROM (SELECT age, p AS "column", x[p + 1] AS value FROM features, (SELECT CAST(range AS INTEGER) AS p FROM range(64)))
    GROUP BY "column" """


@query(
    "variance_threshold",
    """SELECT "column", round(variance, 6) AS variance FROM stats WHERE variance > 0.0155""",
    "features",
    extra={"stats": STATS},
)
def variance_threshold(spark, d):
    m = all_moments(spark, d)
    kept = np.flatnonzero(prep.variance_mask(m, 0.0155))
    return column_table(spark, kept, variance=np.round(prep.column_scores(m)["variance"], 6))


@query("f_regression", """SELECT "column", round(f, 6) AS f FROM stats""", "features", extra={"stats": STATS})
def f_regression(spark, d):
    scores = prep.column_scores(all_moments(spark, d))["f"]
    return column_table(spark, range(len(scores)), f=np.round(scores, 6))


@query(
    "select_percentile",
    """SELECT "column", round(f, 6) AS f FROM stats WHERE f > (SELECT quantile_cont(f, 0.9) FROM stats)""",
    "features",
    extra={"stats": STATS},
)
def select_percentile(spark, d):
    m = all_moments(spark, d)
    kept = np.flatnonzero(prep.percentile_mask(m, 10))
    return column_table(spark, kept, f=np.round(prep.column_scores(m)["f"], 6))


@query("select_fwe")
def select_fwe(spark, d):
    return prep.select_fwe(V.features(spark, d), 0.049).select("subject_id", "x")


@query("rbf_features")
def rbf_features(spark, d):
    return prep.rbf_features(V.features(spark, d), 0.5, 100).select("subject_id", "x")


@query("nystroem")
def nystroem(spark, d):
    return prep.nystroem(V.features(spark, d), "rbf", 0.5, 10).select("subject_id", "x")


@query("feature_agglomeration")
def feature_agglomeration(spark, d):
    return prep.feature_agglomeration(V.features(spark, d), 8, "average", "l1").select("subject_id", "x")


@query("fast_ica")
def fast_ica(spark, d):
    return prep.fast_ica(V.features(spark, d), 4, tol=1e-3, max_iter=30)[0].select("subject_id", "x")


@query("stack_feature")
def stack_feature(spark, d):
    return prep.stack_feature(V.features(spark, d)).select("subject_id", "x")
