"""Fold and split assignment."""

from ..operators import folds
from ..operators.search import best_param as choose
from . import views as V
from .registry import query
from pyspark.sql import functions as F


@query(
    "kfold_contiguous",
    "SELECT o_orderkey AS subject_id, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders",
)
def kfold_contiguous(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("subject_id"))
    return folds.kfold_contiguous(rows, "subject_id", "subject_id", 5).select("subject_id", "fold")


@query(
    "kfold_shuffled",
    """SELECT subject_id, CAST(ntile(5) OVER (ORDER BY md5('42:' || subject_id), subject_id) - 1 AS INTEGER) AS fold
       FROM cohort""",
    "cohort",
)
def kfold_shuffled(spark, d):
    return folds.kfold_shuffled(V.cohort(spark, d), "subject_id", 5, 42).select("subject_id", "fold")


@query(
    "kfold_per_group",
    """SELECT subject_id, site, CAST(ntile(5) OVER (PARTITION BY site ORDER BY md5('42:' || subject_id), subject_id) - 1
       AS INTEGER) AS fold FROM cohort""",
    "cohort",
)
def kfold_per_group(spark, d):
    return folds.kfold_shuffled(V.cohort(spark, d), "subject_id", 5, 42, by=["site"]).select(
        "subject_id", "site", "fold"
    )


@query(
    "train_test_split",
    """SELECT subject_id, row_number() OVER (ORDER BY md5('20:' || subject_id), subject_id)
       <= ceil(0.25 * count(*) OVER ()) AS is_test FROM cohort""",
    "cohort",
)
def train_test_split(spark, d):
    return folds.train_test_split(V.cohort(spark, d), "subject_id", 0.25, 20).select("subject_id", "is_test")


@query("distinct_sites", "SELECT DISTINCT site FROM cohort ORDER BY site", "cohort")
def distinct_sites(spark, d):
    return folds.distinct_sites(V.cohort(spark, d))


# models stand for parameter values, folds come from the order number
@query(
    "best_param",
    """SELECT param, param_pos, round(sum(score * n) / sum(n), 6) AS score FROM (
         SELECT model AS param, CAST(substr(model, 2) AS INTEGER) AS param_pos, -avg(abs(age - prediction)) AS score,
                count(*) AS n FROM predictions GROUP BY model, subject_id % 5)
       GROUP BY param, param_pos ORDER BY score DESC, param_pos LIMIT 1""",
    "predictions",
)
def best_param(spark, d):
    rows = V.predictions(spark, d).withColumn("fold", F.col("subject_id") % 5)
    scores = rows.groupBy(
        F.col("model").alias("param"), F.substring("model", 2, 9).cast("int").alias("param_pos"), "fold"
    ).agg((-F.avg(F.abs(F.col("age") - F.col("prediction")))).alias("score"), F.count("*").alias("n"))
    return choose(scores).withColumn("score", F.round("score", 6))
