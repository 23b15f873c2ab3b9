import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kohort.functions import scalars as S
from kohort.functions.feature_sets import feature_set
from kohort.operators import linkage, search, stats
from kohort.plans import ensemble as E


@pytest.fixture(scope="module")
def study(spark):
    subjects = spark.createDataFrame([("a", 1), ("b", 14), ("c", 1), ("d", 99), ("e", 1)], "subject_id string, site int")
    predictions = spark.createDataFrame(
        [
            ("a", "good", 30.0), ("a", "fair", 95.0), ("a", "poor", 50.0),
            ("b", "good", 40.0), ("b", "fair", 60.0),
            ("c", "good", 20.0), ("c", "good", 22.0), ("c", "fair", 33.0),
            ("d", "good", 40.0),
        ],
        "subject_id string, model string, prediction double",
    )
    errors = spark.createDataFrame([("good", 4.0), ("fair", 5.0), ("poor", 7.0)], "model string, mae double")
    ranges = spark.createDataFrame(
        [(1, 20.0, 80.0), (14, 18.0, 50.0), (99, None, None)], "site int, min_age double, max_age double"
    )
    return subjects, predictions, errors, ranges


def test_ensemble_by_hand(study):
    rows = {r["subject_id"]: r for r in E.ensemble(*study, excluded=(14, "fair")).collect()}
    # a: (30 * 9 + 80 * 4) / 13, spread of the unclipped values, gate drops mae 7
    assert rows["a"]["age"] == round((30 * 9 + 80 * 4) / 13)
    assert np.isclose(rows["a"]["uncertainty"], np.std([30, 95])) and rows["a"]["n_models"] == 2
    assert rows["b"]["age"] == 40 and rows["b"]["n_models"] == 1
    # c: two rows of one model, so only the other counts
    assert rows["c"]["age"] == 33
    # d: no range; e: no model
    assert rows["d"]["age"] is None
    assert rows["e"]["age"] is None and rows["e"]["uncertainty"] is None and rows["e"]["n_models"] == 0


def test_corrected_ensemble_has_no_gate(study, spark):
    subjects, predictions, errors, ranges = study
    train = spark.createDataFrame(
        [(m, a, a + 2.0) for m in ("good", "fair", "poor") for a in (20.0, 40.0, 60.0)],
        "model string, age double, prediction double",
    )
    errors = errors.withColumn("mae", F.when(F.col("model") == "poor", 9.0).otherwise(F.col("mae")))
    out = E.ensemble_bias_corrected(subjects, train, predictions, errors, ranges)
    rows = {r["subject_id"]: r["age"] for r in out.collect()}
    assert rows["a"] == round((28 * 9 + 80 * 4 + 48 * 4) / 17)


def test_final_rounding_is_half_to_even(spark):
    out = spark.createDataFrame([(2.5,), (3.5,), (-0.5,)], "v double").select(S.round_half_even(F.col("v"))).collect()
    assert [r[0] for r in out] == [2, 4, 0]


def test_nonfinite_values(spark):
    df = spark.createDataFrame([([float("nan"), float("inf"), float("-inf"), None, 1.5],)], "x array<double>")
    assert df.select(S.fill_nonfinite(F.col("x")).alias("x")).first()["x"] == [
        0.0, S.LARGEST_DOUBLE, -S.LARGEST_DOUBLE, 0.0, 1.5,
    ]


@pytest.mark.parametrize(
    ("path", "subject"),
    [("/a/b/sub12_gm.nii.gz", "sub12"), ("sub3.npy", "sub3"), ("file:/x/sub.7_wm.npy", "sub.7"), ("/p/sub9", "sub9")],
)
def test_id_from_path(spark, path, subject):
    assert spark.range(1).select(S.id_from_path(F.lit(path)).alias("s")).first()["s"] == subject


def test_feature_sets_keep_repeats():
    sizes = {n: (len(feature_set(n)), len(set(feature_set(n)))) for n in
             ("volume", "curvature", "thickness_volume", "thickness_volume_curvature")}
    assert sizes == {"volume": (102, 102), "curvature": (102, 102), "thickness_volume": (110, 108),
                     "thickness_volume_curvature": (178, 176)}


def test_right_join_keeps_unknown_subjects_and_site_filter_drops_them(spark):
    demo = spark.createDataFrame([("a", 30.0, 1)], "subject_id string, age double, site int")
    imaged = spark.createDataFrame([("a", 1.0), ("z", 2.0)], "subject_id string, v double")
    joined = linkage.join_demographics_right(demo, imaged)
    assert {r["subject_id"]: r["age"] for r in joined.collect()} == {"a": 30.0, "z": None}
    assert linkage.filter_site(joined, 1).count() == 1 and linkage.filter_site(joined, -1).count() == 2


def test_require_ids(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "subject_id string, v int")
    assert linkage.require_ids(df, df.where("v = 1")).count() == 1
    with pytest.raises(KeyError):
        linkage.require_ids(df, spark.createDataFrame([("q",)], "subject_id string"))


def test_correlation_is_pairwise_complete(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(rng.normal(size=(80, 4)) + 1000, columns=list("abcd"))
    frame.loc[::7, "b"] = None
    frame["d"] = frame["d"] * 0 + 3.0
    frame.loc[::5, "c"] = None
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.to_numpy()]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    got = stats.corr_matrix(df, list("abcd")).toPandas().pivot(index="column_a", columns="column_b", values="r")
    want = frame.astype(float).corr()
    assert np.allclose(got.loc["a":"c", "a":"c"], want.loc["a":"c", "a":"c"], atol=1e-9)
    assert got.loc["d", "a"] is None or np.isnan(got.loc["d", "a"])


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(2)
    age = rng.integers(20, 30, 200).astype(float)
    prediction = np.round(age + rng.normal(size=200), 1)
    df = spark.createDataFrame(pd.DataFrame({"age": age, "prediction": prediction}))
    rho = stats.spearman_bias(df).first()["rho"]
    assert np.isclose(rho, pd.Series(age - prediction).rank().corr(pd.Series(age).rank()))


def test_histogram_closes_the_last_bin(spark):
    v = np.array([20.0, 20.4, 21.0, 24.9, 25.0])
    df = spark.createDataFrame(pd.DataFrame({"age": v}))
    got = {r["bin"]: r["n"] for r in stats.histogram(df, "age").collect()}
    want = np.histogram(v, bins=5, range=(20, 25))[0]
    assert got == {i: n for i, n in enumerate(want) if n}


def test_slice_profiles_of_an_uneven_grid(spark):
    grid = np.arange(24.0).reshape(2, 3, 4)
    df = spark.createDataFrame([("a", grid.ravel().tolist())], "subject_id string, x array<double>")
    got = {r["axis"]: r["profile"] for r in stats.slice_profiles(df, (2, 3, 4)).collect()}
    assert got[0] == [*grid.mean((1, 2)), 0.0, 0.0]
    assert got[1] == [*grid.mean((0, 2)), 0.0]
    assert got[2] == list(grid.mean((0, 1)))


def fronts_by_hand(points):
    left, out = list(range(len(points))), []
    while left:
        front = [
            i for i in left
            if not any(
                points[j][0] <= points[i][0] and points[j][1] >= points[i][1] and points[j] != points[i] for j in left
            )
        ]
        out.append(front)
        left = [i for i in left if i not in front]
    return out


def test_fronts_and_survivors(spark):
    rng = np.random.default_rng(7)
    points = [(int(c), float(s)) for c, s in zip(rng.integers(1, 6, 60), -rng.integers(1, 20, 60))]
    df = spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(points)], "candidate int, complexity int, score double")
    fronts = fronts_by_hand(points)
    got = search.pareto_front(df).collect()
    assert {(r["complexity"], r["score"]) for r in got} == {points[i] for i in fronts[0]}
    number = {i: f for f, front in enumerate(fronts) for i in front}
    chosen = search.nsga2_select(df, 25).collect()
    assert len(chosen) == 25
    assert all(number[r["candidate"]] == r["front"] for r in chosen)
    assert sorted(r["front"] for r in chosen) == sorted(number.values())[:25]


def test_near_equal_front_points_count_once(spark):
    df = spark.createDataFrame([(1, 1, -5.0), (2, 100000, -4.0), (3, 100001, -4.0 + 1e-7)], "candidate int, complexity int, score double")
    assert {r["candidate"] for r in search.pareto_front(df).collect()} == {1, 2}


def test_best_param_takes_first_of_ties(spark):
    rows = [("a", 0, -1.0, 10), ("a", 0, -3.0, 10), ("b", 1, -2.0, 20), ("c", 2, -2.5, 5)]
    df = spark.createDataFrame(rows, "param string, param_pos int, score double, n int")
    assert search.best_param(df).first()["param"] == "a"
