"""Rows that must not vanish, move or change: one test per way in which they once could."""

import numpy as np
import pytest
from kohort.operators import features, folds, linkage, neighbours
from kohort.operators.features import map_matrix
from kohort.plans import ensemble, experiments, margins
from kohort.sources import tables


@pytest.mark.parametrize("bad", [None, [1.0, 2.0]])
def test_odd_vectors_are_refused(spark, bad):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, bad)], "id int, x array<double>").coalesce(1)
    with pytest.raises(Exception, match="NULL vectors|different lengths"):
        map_matrix(df, lambda z: z).collect()


def test_model_without_error_is_kept_or_named(spark):
    predictions = spark.createDataFrame([("a", "m1", 1.0), ("a", "m2", 2.0)], "subject_id string, model string, prediction double")
    errors = spark.createDataFrame([("m1", 3.0)], "model string, mae double")
    assert sorted((r.model, r.mae) for r in linkage.lookup_model_error(predictions, errors).collect()) == [("m1", 3.0), ("m2", None)]
    with pytest.raises(KeyError, match="m2"):
        linkage.require_model_errors(predictions, errors)
    train = predictions.selectExpr("model", "prediction", "prediction + 1 AS age").where("model = 'm1'")
    assert ensemble.bias_correct(train, predictions).count() == 2


def test_long_positions_keep_their_order(spark):
    df = spark.createDataFrame([(2**60 + i, f"s{(i * 7) % 10}") for i in range(10)], "position long, subject_id string")
    found = folds.kfold_contiguous(df, "position", "subject_id", 5).orderBy("position").collect()
    assert [r.fold for r in found] == [i // 2 for i in range(10)]


def test_tied_positions_are_dealt_out(spark):
    df = spark.createDataFrame([(f"s{i:02d}", 1, 0, float(i), [1.0]) for i in range(40)], "subject_id string, position long, site int, age double, x array<double>")
    sizes = experiments.nested_folds(df, outer=2, inner=4).selectExpr("explode(inner) AS f").where("f >= 0").groupBy("f").count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 2


def test_site_of_one_row_keeps_it(spark):
    rows = [(f"s{i}", i, 0 if i < 12 else 1) for i in range(13)]
    df = spark.createDataFrame(rows, "subject_id string, position long, site int")
    assert margins._site_folds(df, 2, 2, 0, "position").count() == 13


def test_query_rows_that_share_an_id(spark):
    train = spark.createDataFrame([("t1", [0.0], 10.0), ("t2", [9.0], 90.0)], "subject_id string, x array<double>, age double")
    queries = spark.createDataFrame([("q", [0.0]), ("q", [9.0])], "subject_id string, x array<double>")
    assert sorted(r.prediction for r in neighbours.knn_regress(queries, train, k=1).collect()) == [10.0, 90.0]


def test_oversampling_of_a_repeated_id(spark):
    rows = [(f"a{i}", 0) for i in range(20)] + [("b", 1)] * 3 + [("c", 1), ("d", 1)]
    df = spark.createDataFrame(rows, "subject_id string, label int")
    assert features.oversample_minority(df).groupBy("label").count().collect()[0]["count"] == 20
    assert features.oversample_minority(df).count() == 40


def test_missing_pairs_of_a_key_matrix(spark, tmp_path):
    gram = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 2.0), ("b", "a", 2.0), ("c", "c", 3.0)], "id_a string, id_b string, dot double")
    tables.write_key_matrix(gram, str(tmp_path / "g"))
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "subject_id string")
    found = tables.read_key_matrix(spark, str(tmp_path / "g"), ids).where("dot IS NOT NULL")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, gram.collect()))


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [float("nan")]), (3, [3.0])], "subject_id int, x array<double>")
    assert features.column_medians(df) == [2.0]
    assert np.allclose(sorted(r.x[0] for r in features.impute_median(df, [2.0]).collect()), [1.0, 2.0, 3.0])
