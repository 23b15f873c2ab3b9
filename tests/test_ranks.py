import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kohort.operators import folds, ranks


def test_order_statistics_through_narrow_bands(spark):
    rng = np.random.default_rng(1)
    # a third of the rows share one value
    v = np.concatenate([rng.lognormal(size=2000), np.full(1000, 1.25)])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    wanted = [0, 1, 17, 1499, 1500, 2998, 2999]
    for band_rows in (10_000, 400, 20, 1):
        out = ranks.order_statistics(
            df, "v", lambda n: F.lit(wanted).cast("array<bigint>"), grid=16, band_rows=band_rows
        )
        got = {r["rank"]: r["value"] for r in out.collect()}
        assert got == {r: np.sort(v)[r] for r in wanted}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100])
def test_quantiles_equal_numpy(spark, n):
    v = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "g": ["a"] * n}))
    q = ranks.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], ["g"]).first()["q"]
    assert np.allclose(q, np.quantile(v, [0.0, 0.25, 0.5, 0.9, 1.0]), atol=1e-12)


def test_quantiles_skip_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert ranks.exact_quantiles(df, "v", [0.5]).first()["q"] == [2.0]


def test_average_ranks_with_heavy_ties(spark):
    v = np.concatenate([np.arange(50) % 7, np.full(40, 3)]).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "v": v}))
    out = ranks.average_ranks(df, "v", "r", buckets=4).toPandas().sort_values("id")
    assert np.array_equal(out["r"].to_numpy(), pd.Series(v).rank().to_numpy())


@pytest.mark.parametrize(("n", "k"), [(10, 3), (11, 5), (4, 4), (3, 5)])
def test_contiguous_fold_sizes(spark, n, k):
    df = spark.range(n).select(F.col("id").alias("position"), F.col("id").cast("string").alias("subject_id"))
    got = folds.kfold_contiguous(df, "position", "subject_id", k).orderBy("position").collect()
    want = np.concatenate([np.full(len(p), i) for i, p in enumerate(np.array_split(np.arange(n), k))])
    assert [r["fold"] for r in got] == list(want)


def test_shuffled_folds_ignore_partitioning_and_keep_copies_together(spark, small):
    df, *_ = small
    one = {r["subject_id"]: r["fold"] for r in folds.kfold_shuffled(df, "subject_id", 5).collect()}
    two = {r["subject_id"]: r["fold"] for r in folds.kfold_shuffled(df.repartition(7), "subject_id", 5).collect()}
    assert one == two
    assert sorted(pd.Series(one).value_counts()) == [12] * 5
    doubled = folds.kfold_shuffled(df.unionByName(df), "subject_id", 5)
    assert doubled.groupBy("subject_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_folds_restart_per_site_even_for_tiny_sites(spark):
    df = spark.createDataFrame([("a", 0)] + [(f"b{i}", 1) for i in range(11)], "subject_id string, site int")
    got = folds.kfold_shuffled(df, "subject_id", 5, by=["site"]).toPandas()
    assert got[got.site == 0].fold.tolist() == [0]
    assert sorted(got[got.site == 1].fold.value_counts()) == [2, 2, 2, 2, 3]


def test_split_size(spark, small):
    out = folds.train_test_split(small[0], "subject_id", 0.25).groupBy("is_test").count().collect()
    assert {r["is_test"]: r["count"] for r in out} == {True: 15, False: 45}
