"""Joins, lookups and set operations."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import linkage
from . import views as V
from .registry import query

NINE = ",\n".join(
    f"""t{k} AS (SELECT replace('sub' || vec_id || '_raw/', '_raw/', '') AS subject_id, """
    + ", ".join(f"CAST(embedding[{7 * (k - 1) + i + 1}] AS DOUBLE) AS r{k}_{i}" for i in range(7))
    + f" FROM embeddings WHERE vec_id % 50 <> {k})"
    for k in range(1, 10)
)
MERGED = "t1 " + " ".join(f"JOIN t{k} USING (subject_id)" for k in range(2, 10))
REGIONS = ", ".join(f"r{k}_{i}" for k in range(1, 10) for i in range(7))


def region_tables(spark, d):
    """Nine region tables with the key suffix removed."""
    tables = [V.region_table(spark, d, k) for k in range(1, V.REGION_TABLES + 1)]
    return [t.select(S.strip_key_suffix(F.col("key")).alias("subject_id"), *t.columns[1:]) for t in tables]


@query("join_region_tables", f"WITH {NINE} SELECT subject_id, {REGIONS} FROM {MERGED}")
def join_region_tables(spark, d):
    return linkage.join_tables(region_tables(spark, d), "subject_id")


@query(
    "join_named_keys",
    """SELECT 'sub' || vec_id || '_raw/' AS volume_key, CAST(embedding[1] AS DOUBLE) AS r1_0, CAST(embedding[8] AS DOUBLE) AS r2_0
       FROM embeddings WHERE vec_id % 50 NOT IN (1, 2)""",
)
def join_named_keys(spark, d):
    left = V.region_table(spark, d, 1).select(F.col("key").alias("volume_key"), "r1_0")
    right = V.region_table(spark, d, 2).select(F.col("key").alias("thickness_key"), "r2_0")
    return linkage.join_named_keys(left, right, "volume_key", "thickness_key")


@query(
    "join_demographics_right",
    """SELECT f.subject_id, c.age, c.gender, c.site, f.x[1] AS x0 FROM cohort c RIGHT JOIN features f
       ON c.subject_id = f.subject_id""",
    "cohort",
    "features",
)
def join_demographics_right(spark, d):
    imaged = V.features(spark, d).select("subject_id", F.col("x")[0].alias("x0"))
    return linkage.join_demographics_right(V.cohort(spark, d), imaged)


ERROR_COLUMNS = ", ".join(
    f"avg(CASE WHEN model = 'm{i}' THEN abs(age - prediction) END) AS m{i}" for i in range(1, 8)
)
ALL_MODELS = " AND ".join(f"m{i} IS NOT NULL" for i in range(1, 8))
ROUNDED = ", ".join(f"round(m{i}, 6) AS m{i}" for i in range(1, 8))


@query(
    "join_predictions_inner",
    f"SELECT subject_id, {ROUNDED} FROM wide WHERE {ALL_MODELS}",
    "predictions",
    extra={"wide": f"SELECT subject_id, {ERROR_COLUMNS} FROM predictions GROUP BY subject_id"},
)
def join_predictions_inner(spark, d):
    errors = V.predictions(spark, d).select(
        "subject_id", "model", S.abs_error(F.col("age"), F.col("prediction")).alias("error")
    )
    wide = linkage.common_subjects(errors, V.MODELS)
    return wide.select("subject_id", *[V.r6(m, m) for m in V.MODELS])


@query(
    "reindex_to_list",
    """SELECT i.position, i.subject_id, c.age, c.site FROM
       (SELECT vec_id AS position, 'sub' || vec_id AS subject_id FROM embeddings) i
       LEFT JOIN cohort c ON c.subject_id = i.subject_id ORDER BY position""",
    "cohort",
)
def reindex_to_list(spark, d):
    wanted = V.features(spark, d).select("position", "subject_id")
    rows = V.cohort(spark, d).select("subject_id", "age", "site")
    return linkage.reindex_to_list(rows, wanted).select("position", "subject_id", "age", "site")


@query("require_ids", "SELECT subject_id FROM features WHERE subject_id NOT IN (SELECT subject_id FROM cohort)", "cohort", "features")
def require_ids(spark, d):
    return linkage.missing_ids(V.cohort(spark, d), V.features(spark, d))


@query(
    "lookup_model_error",
    "SELECT p.subject_id, p.model, round(e.mae, 6) AS mae FROM predictions p JOIN model_errors e ON p.model = e.model WHERE NOT p.is_train",
    "predictions",
    "model_errors",
)
def lookup_model_error(spark, d):
    rows = V.test_predictions(spark, d).select("subject_id", "model")
    return linkage.lookup_model_error(rows, V.model_errors(spark, d)).select("subject_id", "model", V.r6("mae", "mae"))


@query(
    "lookup_site_range",
    "SELECT s.subject_id, s.site, r.min_age, r.max_age FROM subjects s LEFT JOIN site_ranges r ON s.site = r.site WHERE NOT s.is_train",
    "subjects",
    "site_ranges",
)
def lookup_site_range(spark, d):
    rows = V.subjects(spark, d).where("NOT is_train").select("subject_id", "site")
    return linkage.lookup_site_range(rows, V.site_ranges(spark, d)).select("subject_id", "site", "min_age", "max_age")


@query("exactly_one_match", "SELECT subject_id, model, prediction FROM one_each", "one_each")
def exactly_one_match(spark, d):
    return linkage.exactly_one_match(V.test_predictions(spark, d))


@query(
    "pair_modalities",
    """SELECT subject_id, x[1] AS first_0, x[64] AS first_63, x[64] AS second_0, x[1] AS second_63 FROM features""",
    "features",
)
def pair_modalities(spark, d):
    pairs = linkage.pair_modalities(V.features(spark, d), V.features_b(spark, d))
    return pairs.select(
        "subject_id",
        F.col("x_first")[0].alias("first_0"),
        F.col("x_first")[63].alias("first_63"),
        F.col("x_second")[0].alias("second_0"),
        F.col("x_second")[63].alias("second_63"),
    )


@query(
    "union_by_name",
    """SELECT subject_id, site, age, 'train' AS part FROM subjects WHERE is_train
       UNION ALL SELECT subject_id, site, prediction AS age, 'test' AS part FROM predictions WHERE NOT is_train""",
    "subjects",
    "predictions",
)
def union_by_name(spark, d):
    train = V.subjects(spark, d).where("is_train").select("subject_id", "site", "age", F.lit("train").alias("part"))
    test = V.test_predictions(spark, d).select(
        F.lit("test").alias("part"), F.col("prediction").alias("age"), "site", "subject_id"
    )
    return linkage.stack_by_name(train, test)
