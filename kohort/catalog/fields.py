"""Projections, filters and scalar functions."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import linkage
from ..operators.folds import distinct_sites
from . import views as V
from .registry import query


@query("strip_key_suffix", "SELECT vec_id, replace('sub' || vec_id || '_raw/', '_raw/', '') AS subject_id FROM embeddings")
def strip_key_suffix(spark, d):
    keyed = V.table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("sub"), "vec_id", F.lit("_raw/")).alias("key"))
    return keyed.select("vec_id", S.strip_key_suffix(F.col("key")).alias("subject_id"))


@query(
    "id_from_path",
    """SELECT vec_id, split_part(regexp_extract('/study/gm/sub' || vec_id || '_gm.nii.gz', '[^/]+$', 0), '_', 1) AS subject_id,
       trim('sub' || vec_id || '_wm.nii.gz', '_wm.nii.gz') AS stripped FROM embeddings""",
)
def id_from_path(spark, d):
    names = V.table(spark, d, "embeddings").select(
        "vec_id",
        F.concat(F.lit("/study/gm/sub"), "vec_id", F.lit("_gm.nii.gz")).alias("path"),
        F.concat(F.lit("sub"), "vec_id", F.lit("_wm.nii.gz")).alias("file"),
    )
    return names.select(
        "vec_id",
        S.id_from_path(F.col("path")).alias("subject_id"),
        S.strip_characters(F.col("file"), "_wm.nii.gz").alias("stripped"),
    )


FEATURE_SET = ["r1_3", "r1_0", "r1_3", "r1_6"]


@query(
    "select_feature_set",
    """SELECT 'sub' || vec_id AS subject_id, CAST(embedding[4] AS DOUBLE) AS x0, CAST(embedding[1] AS DOUBLE) AS x1,
       CAST(embedding[4] AS DOUBLE) AS x2, CAST(embedding[7] AS DOUBLE) AS x3, 4 AS n
       FROM embeddings WHERE vec_id % 50 <> 1""",
)
def select_feature_set(spark, d):
    rows = V.region_table(spark, d, 1).select(
        S.strip_key_suffix(F.col("key")).alias("subject_id"), F.array(*FEATURE_SET).alias("x")
    )
    return rows.select("subject_id", *[F.col("x")[i].alias(f"x{i}") for i in range(4)], F.size("x").alias("n"))


@query("drop_columns", "SELECT subject_id, age FROM cohort", "cohort")
def drop_columns(spark, d):
    return V.cohort(spark, d).drop("gender", "site")


@query("rename_columns", "SELECT subject_id, age AS predictions, gender AS sex, site FROM cohort", "cohort")
def rename_columns(spark, d):
    return V.cohort(spark, d).withColumnsRenamed({"age": "predictions", "gender": "sex"})


@query("cast_float32", "SELECT subject_id, CAST(CAST(age AS FLOAT) AS DOUBLE) AS age FROM cohort", "cohort")
def cast_float32(spark, d):
    return V.cohort(spark, d).select("subject_id", S.as_float32(F.array("age"))[0].alias("age"))


@query("cast_int_label", "SELECT subject_id, CAST(trunc(age) AS INTEGER) AS label FROM cohort", "cohort")
def cast_int_label(spark, d):
    return V.cohort(spark, d).select("subject_id", S.int_label(F.col("age")).alias("label"))


@query(
    "add_null_columns",
    "SELECT subject_id, gender, site, CAST(NULL AS DOUBLE) AS age, CAST(NULL AS DOUBLE) AS uncertainty FROM cohort",
    "cohort",
)
def add_null_columns(spark, d):
    empty = F.lit(None).cast("double")
    return V.cohort(spark, d).drop("age").withColumns({"age": empty, "uncertainty": empty})


@query("shift_column", "SELECT subject_id, site + CAST(0.5 AS DOUBLE) AS site FROM cohort", "cohort")
def shift_column(spark, d):
    return V.cohort(spark, d).select("subject_id", (F.col("site") + 0.5).alias("site"))


@query("filter_site", "SELECT * FROM cohort WHERE site = 14", "cohort")
def filter_site(spark, d):
    return linkage.filter_site(V.cohort(spark, d), 14)


@query("filter_in_ids", "SELECT * FROM cohort WHERE subject_id IN (SELECT subject_id FROM features)", "cohort", "features")
def filter_in_ids(spark, d):
    return linkage.filter_in_ids(V.cohort(spark, d), V.features(spark, d))


SPOILED = """SELECT 'sub' || vec_id AS subject_id, p, CASE WHEN (vec_id + p) % 97 = 0 THEN CAST('nan' AS DOUBLE)
    WHEN (vec_id + p) % 101 = 0 THEN CAST('infinity' AS DOUBLE) ELSE CAST(embedding[p + 1] AS DOUBLE) END AS v
    FROM embeddings, (SELECT range AS p FROM range(64))"""
FILLED = """SELECT subject_id, p, CASE WHEN isnan(v) THEN 0.0 WHEN isinf(v) THEN sign(v) * 1.7976931348623157e308
    ELSE v END AS v FROM spoiled"""


@query(
    "fill_nonfinite",
    "SELECT subject_id, CAST(p AS INTEGER) AS p, v FROM filled",
    extra={"spoiled": SPOILED, "filled": FILLED},
)
def fill_nonfinite(spark, d):
    return V.volumes(spark, d).select("subject_id", F.posexplode(S.fill_nonfinite(F.col("x"))).alias("p", "v"))


MASK = [p for p in range(64) if p % 3 != 0]


@query(
    "mask_select",
    """SELECT subject_id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY p) - 1 AS INTEGER) AS slot, v
       FROM filled WHERE p % 3 <> 0""",
    extra={"spoiled": SPOILED, "filled": FILLED},
)
def mask_select(spark, d):
    kept = S.select_positions(S.fill_nonfinite(F.col("x")), MASK)
    return V.volumes(spark, d).select("subject_id", F.posexplode(kept).alias("slot", "v"))


@query(
    "flatten_concat",
    """SELECT 'sub' || vec_id AS subject_id, CAST(p AS INTEGER) AS slot,
       CAST(CASE WHEN p < 64 THEN embedding[p + 1] ELSE embedding[128 - p] END AS DOUBLE) AS v
       FROM embeddings, (SELECT range AS p FROM range(128))""",
)
def flatten_concat(spark, d):
    both = linkage.pair_modalities(V.features(spark, d), V.features_b(spark, d))
    return both.select("subject_id", F.posexplode(F.concat("x_first", "x_second")).alias("slot", "v"))


@query(
    "onehot_weighted",
    """SELECT subject_id, CAST(s.site AS INTEGER) AS slot, CAST(CASE WHEN c.site = s.site THEN 10000 ELSE 0 END AS DOUBLE) AS v
       FROM cohort c, (SELECT DISTINCT site FROM cohort) s""",
    "cohort",
)
def onehot_weighted(spark, d):
    people = V.cohort(spark, d)
    # the fitted encoder: sorted distinct sites
    levels = [r.site for r in distinct_sites(people).collect()]
    coded = people.select("subject_id", F.posexplode(S.onehot(F.col("site"), levels)).alias("slot", "v"))
    return coded.select("subject_id", F.element_at(F.lit(levels), F.col("slot") + 1).alias("slot"), "v")


CLIP = """SELECT p.subject_id, p.model, least(greatest(p.prediction, r.min_age), r.max_age) AS clipped
    FROM predictions p JOIN site_ranges r ON p.site = r.site WHERE NOT p.is_train AND r.min_age IS NOT NULL"""


@query("clip_to_range", CLIP, "predictions", "site_ranges")
def clip_to_range(spark, d):
    rows = linkage.lookup_site_range(V.test_predictions(spark, d), V.site_ranges(spark, d))
    clipped = S.clip_to_range(F.col("prediction"), F.col("min_age"), F.col("max_age"))
    return rows.select("subject_id", "model", clipped.alias("clipped")).where("clipped IS NOT NULL")


@query("abs_error", "SELECT subject_id, model, round(abs(age - prediction), 6) AS error FROM predictions", "predictions")
def abs_error(spark, d):
    return V.predictions(spark, d).select(
        "subject_id", "model", V.r6(S.abs_error(F.col("age"), F.col("prediction")), "error")
    )


@query(
    "weight_from_mae",
    "SELECT model, round(CASE WHEN mae < 7 THEN (7 - mae) * (7 - mae) END, 6) AS weight FROM model_errors",
    "model_errors",
)
def weight_from_mae(spark, d):
    return V.model_errors(spark, d).select("model", V.r6(S.weight_from_mae(F.col("mae")), "weight"))


@query("round_half_even", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS INTEGER) AS age FROM lineitem")
def round_half_even(spark, d):
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", S.round_half_even(F.col("l_quantity") / 2).alias("age")
    )


@query(
    "format_report",
    """SELECT rpad(upper(CAST(subject_id AS VARCHAR)), 12, ' ') || ' ' || printf('pred %7.3f', floor(prediction * 1000 + 0.5) / 1000) || ' ' ||
       printf('err %7.3f', floor(abs(age - prediction) * 1000 + 0.5) / 1000) AS line FROM predictions WHERE NOT is_train""",
    "predictions",
)
def format_report(spark, d):
    rows = V.test_predictions(spark, d)
    error = S.abs_error(F.col("age"), F.col("prediction"))
    return rows.select(S.report_line(F.col("subject_id").cast("string"), pred=F.col("prediction"), err=error).alias("line"))
