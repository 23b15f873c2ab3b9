"""Work and copies that may not grow with the square of the rows, and results beyond one tile or block."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kohort.catalog import views as V
from kohort.operators import arrays, gram, neighbours, newton, svr
from kohort.sources import tables


def table(spark, n, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    site = rng.integers(0, 3, n)
    frame = pd.DataFrame({"subject_id": [f"s{i:05d}" for i in range(n)], "position": np.arange(n), "site": site, "x": list(x), "age": rng.normal(size=n)})
    return spark.createDataFrame(frame, "subject_id string, position long, site int, x array<double>, age double").repartition(3), x, site


def test_blocks_follow_bytes_and_cores_not_rows():
    assert gram.blocks_needed(100_000, 64, gram.CHUNK, None, 10) == 10
    assert gram.blocks_needed(10_000_000, 64, gram.CHUNK, None, 10) == 153
    assert gram.blocks_needed(1500, 64, gram.CHUNK, None, 10) == 2
    left, right = gram.rectangle_blocks(25_000, 75_000, 64, gram.CHUNK, None, 6)
    assert left < right and 48 <= left * right < 80
    # a task that adds up chunks holds all its products
    assert gram.rows_held(1 << 20, 64) <= 1024


def test_gram_beyond_one_tile(spark):
    df, x, site = table(spark, 1300)
    n = len(x)
    want = x @ x.T
    sums = F.count("*"), F.countDistinct("id_a", "id_b"), F.sum("dot"), F.sum(F.col("dot") * F.col("ka") * F.col("kb")), F.sum(F.col("dot") * F.col("ka"))
    keys = [F.substring(c, 2, 5).cast("double").alias(k) for c, k in (("id_a", "ka"), ("id_b", "kb"))]

    def check(out, mask):
        got = out.select("*", *keys).agg(*sums).first()
        k = np.arange(n, dtype=float)
        chosen = want * mask
        assert got[0] == got[1] == mask.sum()
        assert np.allclose(got[2:], [chosen.sum(), k @ chosen @ k, (k @ chosen).sum()], rtol=1e-6)

    check(gram.gram_matrix(df), np.ones((n, n), bool))
    check(gram.gram_matrix(df, block_rows=1300), np.ones((n, n), bool))
    check(gram.gram_matrix(df, within="site"), site[:, None] == site[None, :])
    even = np.arange(n) % 4 == 0
    check(gram.gram_rectangle(df.where("position % 4 = 0"), df.where("position % 4 <> 0")), even[:, None] & ~even[None, :])


def test_r6_of_many_values_is_r6(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=5000), (rng.integers(-(10**8), 10**8, 5000) + 0.5) / 1e6, [0.0, -0.0, -1e-9, 5e-7, -5e-7, np.nan, np.inf, -1e300, 1e6]])
    out = spark.createDataFrame(pd.DataFrame({"v": v}), "v double").select(V.r6_many("v", "a"), V.r6("v", "b")).toPandas()
    assert (out.a.to_numpy().view(np.int64) == out.b.to_numpy().view(np.int64)).all()


def test_key_matrix_of_a_thousand_subjects(spark, tmp_path):
    """A line took the square of its cells before: 700 million comparisons here."""
    n, path = 900, str(tmp_path / "m")
    ids = F.format_string("s%04d", F.col("id"))
    pairs = spark.range(n).select(ids.alias("id_a"), F.col("id").alias("i")).crossJoin(spark.range(n).select(ids.alias("id_b"), F.col("id").alias("j")))
    pairs = pairs.select("id_a", "id_b", (F.sin(F.col("i") * 1000 + F.col("j")) * F.pow(F.lit(10.0), F.col("j") % 40 - 20)).alias("dot"))
    tables.write_key_matrix(pairs.repartition(4), path)
    wanted = spark.range(0, 2 * n, 2).select(ids.alias("subject_id"))
    got = tables.read_key_matrix(spark, path, wanted.unionByName(wanted))
    want = pairs.join(wanted.withColumnRenamed("subject_id", "id_a"), "id_a", "left_semi").join(wanted.withColumnRenamed("subject_id", "id_b"), "id_b", "left_semi")
    both = got.join(want.withColumnRenamed("dot", "want"), ["id_a", "id_b"])
    assert got.count() == both.where("dot = want").count() == (n // 2) ** 2


def test_key_matrix_keeps_special_values_and_refuses_two_of_a_pair(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = [("a", "a", float("nan")), ("a", "b", float("inf")), ("b", "a", float("-inf")), ("b", "b", None), ("c", "c", 1e-300), ("c", "a", -0.0)]
    tables.write_key_matrix(spark.createDataFrame(rows, "id_a string, id_b string, dot double"), path)
    ids = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "subject_id string")
    got = {(r.id_a, r.id_b): r.dot for r in tables.read_key_matrix(spark, path, ids).collect()}
    assert len(got) == 9 and np.isnan(got["a", "a"]) and got["a", "b"] == np.inf and got["b", "a"] == -np.inf
    assert got["c", "c"] == 1e-300 and str(got["c", "a"]) == "-0.0" and [k for k, v in got.items() if v is None] != [] and got["b", "b"] is None
    with pytest.raises(Exception, match="several values"):
        tables.write_key_matrix(spark.createDataFrame([("a", "b", 1.0), ("a", "b", 1.0)], "id_a string, id_b string, dot double"), path + "2")


@pytest.mark.parametrize("kind", ["plain", "copies", "far", "lattice"])
def test_bounds_keep_what_all_differences_keep(kind):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(300, 6)), rng.normal(size=(9000, 6))
    if kind == "copies":
        a[:20], b[::3] = b[100], b[100]
    if kind == "far":
        # the nearest come last, lengths differ widely, and rounding hides small differences
        b = np.concatenate([b[:5000] * 1e9, 1e6 + b[:3000] * 1e-4, b[5000:]])
        a[:100] = 1e6 + a[:100] * 1e-4
    if kind == "lattice":
        a, b = np.round(a), np.round(b)
    for take in (1, 7):
        order, distance = neighbours.nearest_euclidean(a, b, take)
        want_order, want_distance = neighbours.nearest_by_difference(a, b, take, 2)
        assert (order == want_order).all() and (distance == want_distance).all()


def test_neighbours_see_few_copies_of_rows(spark):
    """Rows travelled n / 1024 times before, and all differences were formed."""
    df, x, _ = table(spark, 6000, 3)
    out = neighbours.nearest(df.where("position % 4 = 0"), df.where("position % 4 <> 0"), k=3).toPandas()
    assert len(out) == 4500
    train = np.flatnonzero(np.arange(6000) % 4)
    for q in range(0, 6000, 400):
        gap = np.sqrt(((x[train] - x[q]) ** 2).sum(1))
        want = train[np.argsort(gap, kind="stable")[:3]]
        got = out[out["query"] == f"s{q:05d}"].sort_values("distance")
        assert got.neighbour.tolist() == [f"s{i:05d}" for i in want] and np.allclose(got.distance, np.sort(gap)[:3], rtol=1e-12)


def test_pairs_of_small_classes_need_no_shared_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    label = np.repeat([3, 5, 8, 9], [40, 25, 30, 1])
    x = rng.normal(size=(96, 3)) + label[:, None] * np.array([0.5, -0.2, 0.1])
    df = spark.createDataFrame(pd.DataFrame({"x": list(x), "label": label}), "x array<double>, label int").repartition(3)
    classes, weights = [3, 5, 8, 9], {3: 0.5, 5: 1.5, 8: 1.0, 9: 4.0}
    shared = svr._solve_pairs
    monkeypatch.setattr(svr, "_solve_pairs", None)
    w, first, second = svr.fit_one_vs_one(df, classes, 0.7, weights)
    with pytest.raises(newton.NotConverged, match="pairs"):
        svr.fit_one_vs_one(df, classes, 0.7, weights, max_passes=2)
    # some pairs, then all of them, in passes over all rows
    monkeypatch.setattr(svr, "_solve_pairs", shared)
    for most in (8 * 4 * 30, 0):
        monkeypatch.setattr(svr, "CLASS_BYTES", max(most, 1))
        again = svr.fit_one_vs_one(df, classes, 0.7, weights)
        assert np.allclose(w, again[0], atol=1e-6) and (first == again[1]).all() and (second == again[2]).all()


def test_wide_hessians_take_little_more_than_their_sums():
    """The square, its triangle and two copies of it were held before."""
    rng = np.random.default_rng(5)
    n, p = 20, 1500
    z, one, zero = rng.normal(size=(n, p)), np.ones((n, 1)), np.zeros(1)
    w = rng.normal(size=(1, p)) * 1e-2
    settings = (w, w * 0.1, one, zero, np.ones(1), np.zeros(1, bool), False)
    tracemalloc.start()
    got = newton.margin_sums(z, None, one, *settings)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.8 * got.nbytes
    assert np.allclose(got, newton.margin_sums(z, newton.outer_products(z), one, *settings), rtol=1e-9, atol=1e-9)


def test_sums_leave_in_small_batches():
    sums = {0: np.arange(3_000_000.0).reshape(2, -1), 3: np.arange(5.0)}
    batches = list(arrays.sliced(sums))
    assert max(b.nbytes for b in batches) < 10 << 20
    for g, s in sums.items():
        rows = [r for b in batches for r in b.to_pylist() if r["g"] == g]
        assert [r["part"] for r in rows] == list(range(len(rows)))
        assert (np.concatenate([r["s"] for r in rows]) == s.ravel()).all()
