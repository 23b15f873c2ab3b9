import numpy as np
import pytest
from pyspark.sql import functions as F

from kohort.operators import linear
from kohort.plans import experiments as X
from kohort.session import settle, work_folder
from kohort.sources import models, tables, volumes


def test_work_folder_follows_the_session(spark):
    folder = work_folder(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert folder.startswith(base) and folder != work_folder(spark)


def test_settled_tables_have_a_size_to_broadcast(spark):
    small = settle(spark.range(1000).groupBy((F.col("id") % 5).alias("k")).count())
    plan = spark.range(10000).withColumn("k", F.col("id") % 5).join(small, "k")
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", [(4, "i2"), (16, "f4"), (64, "f8"), (2, "u1")])
def test_nifti_types_orders_and_scaling(order, kind):
    code, name = kind
    values = np.arange(24).reshape(2, 3, 4)
    header = bytearray(352)

    def put(at, fmt, *numbers):
        raw = np.array(numbers, order + fmt).tobytes()
        header[at : at + len(raw)] = raw

    put(0, "i4", 348)
    put(40, "i2", 3, 2, 3, 4)
    put(70, "i2", code)
    put(108, "f4", 352, 2.0, 1.0)
    header[344:348] = b"n+1\0"
    raw = bytes(header) + values.astype(order + name).tobytes(order="F")
    assert np.allclose(volumes.decode_nifti(raw), values * 2 + 1)


def test_damaged_volumes_are_reported(spark):
    base = work_folder(spark)
    rows = spark.createDataFrame(
        [("s1", [1.0, 2.0, 3.0, 4.0], [2, 2, 1]), ("s2", [5.0, 6.0, 7.0, 8.0], [2, 2, 1])],
        "subject_id string, x array<double>, shape array<int>",
    )
    volumes.write_array_files(rows.where("subject_id = 's1'"), base, volumes.encode_nifti, "_gm.nii.gz").count()
    volumes.write_array_files(rows.where("subject_id = 's2'"), base, lambda v: b"junk", "_gm.nii.gz").count()
    got = {r["subject_id"]: r for r in volumes.convert_volumes(spark, base, base + "/table").collect()}
    assert got["s1"]["x"] == [1.0, 2.0, 3.0, 4.0] and got["s1"]["shape"] == [2, 2, 1] and got["s1"]["error"] is None
    assert got["s2"]["x"] is None and "ValueError" in got["s2"]["error"]


@pytest.mark.parametrize(
    ("path", "level", "name"),
    [
        ("file:/out/wm+gm.csv", 0, "wm+gm"),
        ("file:/out/my%20model/cv/predictions.csv", 2, "my model"),
        ("/out/model=m1/part-0.csv", 1, "m1"),
    ],
)
def test_model_names_from_paths(spark, path, level, name):
    assert spark.range(1).select(tables.name_from_path(F.lit(path), level).alias("n")).first()["n"] == name


def test_key_matrix_round_trip(spark):
    rows = [(a, b, float(i * 10 + j)) for i, a in enumerate("pqr") for j, b in enumerate("pqr")]
    path = work_folder(spark)
    tables.write_key_matrix(spark.createDataFrame(rows, "id_a string, id_b string, dot double").repartition(2), path)
    ids = spark.createDataFrame([("p",), ("r",)], "subject_id string")
    got = {(r["id_a"], r["id_b"], r["dot"]) for r in tables.read_key_matrix(spark, path, ids).collect()}
    assert got == {r for r in rows if "q" not in r[:2]}


def test_saved_models_predict_as_before(spark, small):
    df, x, _, frame = small
    model = X.refit_full(df, X.Pipeline(lambda m: linear.ridge(m, 1.0)), scale=True)
    path = work_folder(spark)
    models.save_coefficients(spark, model, path)
    got = models.score_saved_model(df, path).toPandas().set_index("subject_id").prediction
    assert np.allclose(got[frame.subject_id], x @ model[1] + model[0])
    fitted = models.fit_pipeline(df)
    models.save_pipeline(fitted, path + "-pipeline")
    again = models.score_pipeline(df, path + "-pipeline").toPandas().set_index("subject_id").prediction
    b, w = X.refit_full(df, X.Pipeline(linear.ols))
    assert np.allclose(again[frame.subject_id], x @ w + b, atol=1e-6)


def test_metric_table(spark):
    scores = spark.createDataFrame([("a", -4.5), ("b", 3.0)], "model string, score double")
    got = {r["model"]: r["mae"] for r in tables.metric_table([scores], {"c": 5.0}).collect()}
    assert got == {"a": 4.5, "b": 3.0, "c": 5.0}


def test_infinite_voxels_become_the_largest_float(spark, tmp_path):
    values = np.array([1.5, np.inf, -np.inf, np.nan], np.float32)
    np.save(tmp_path / "sub1_gm.npy", values)
    row = volumes.scan_array_files(spark, str(tmp_path)).first()
    assert row.x == [1.5, float(np.finfo(np.float32).max), float(np.finfo(np.float32).min), 0.0]
