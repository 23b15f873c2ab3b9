"""Support vector fits against their dual, at any width, per group and on held-out tables."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from kohort.operators import isometry, linear, moments, newton, svr
from kohort.operators.scoring import predict_column
from kohort.plans import experiments, margins
from pyspark.sql import functions as F


def primal(x, y, b, w, c, epsilon):
    return 0.5 * w @ w + c * np.maximum(np.abs(x @ w + b - y) - epsilon, 0).sum()


def flagged(df):
    return df.withColumn("train", F.array(F.lit(1.0)))


@pytest.mark.parametrize("loss", ["epsilon_insensitive", "squared"])
@pytest.mark.parametrize("penalise", [False, True])
def test_gap_is_a_proof(small, loss, penalise):
    """A fit to a hundredth of the gap is never below the bound that the coarse fit states."""
    df = flagged(small[0])
    problems = [svr.Problem(c, 0, 0.1, loss, penalise) for c in margins.C_GRID]
    coarse, fine = (svr.solve_problems(df, problems, gap=g)[0] for g in (1e-2, 1e-5))
    for a, b in zip(coarse, fine):
        assert 0 <= a.gap <= 1e-2 and 0 <= b.gap <= 1e-5
        assert a.objective * (1 - a.gap) <= b.objective * (1 + 1e-9) and b.objective <= a.objective * (1 + 1e-9)


def test_objective_is_the_plain_loss(small):
    df, x, y, _ = small
    s = svr.solve_problems(flagged(df), [svr.Problem(0.5, 0, 0.1)])[0][0]
    assert np.isclose(s.objective, primal(x, y, s.intercept, s.coef, 0.5, 0.1))


def test_waves_and_tasks_do_not_change_a_fit(small, monkeypatch):
    df = flagged(small[0])
    problems = [svr.Problem(c, 0, 0.1) for c in (0.1, 0.5, 1.0)]
    whole = svr.solve_problems(df, problems, group="site", gap=1e-6)
    monkeypatch.setattr(newton, "WAVE_BYTES", 8 * newton.length(6) * 2)
    parts = svr.solve_problems(df.repartition(7), problems, group="site", gap=1e-6)
    for site in (0, 1, 2):
        for a, b in zip(whole[site], parts[site]):
            assert np.isclose(a.objective, b.objective, rtol=1e-5)


def test_awkward_groups(spark):
    rows = [("a", 0, [1.0, 2.0], 3.0, [1, 0]), ("b", 0, [2.0, 1.0], 5.0, [1, 0]), ("c", 1, [1.0, 1.0], 9.0, [1, 0]), ("d", None, [5.0, 5.0], 1e6, [1, 1])]
    df = spark.createDataFrame(rows, "subject_id string, site int, x array<double>, age double, train array<int>")
    found = svr.solve_problems(df, [svr.Problem(1.0, 0), svr.Problem(1.0, 1)], group="site")
    assert sorted(found) == [0, 1]
    # no training rows: zero coefficients
    assert all((found[g][1].coef == 0).all() and found[g][1].gap == 0 for g in (0, 1))
    # one row: within its tube, up to the gap
    assert abs(found[1][0].coef @ [1.0, 1.0] + found[1][0].intercept - 9.0) < 0.11
    empty = svr.solve_problems(df.where("false"), [svr.Problem(1.0)])
    assert empty[0][0].objective == 0


def test_linear_grid_is_whole():
    grid = margins.linear_grid()
    assert len(grid) == 2 * 2 * 5 * 8 * 5 and {g["c"] for g in grid} == set(margins.C_GRID) == {2.0**e for e in range(-6, 2)}


def test_grid_shares_fits_of_equal_optima(small):
    grid = [{"c": 0.5, "epsilon": 0.1, "tol": t} for t in (1e-5, 1e-1)] + [{"c": 0.5, "epsilon": 1.0, "tol": 1e-5}]
    a, b, c = margins.svr_grid(small[0], grid, 3)
    assert a["mae"] == b["mae"] != c["mae"] and max(g["gap"] for g in (a, b, c)) <= 1e-3 and [g["param_pos"] for g in (a, b, c)] == [0, 1, 2]


def test_holdout_per_site_equals_separate_studies(small):
    df, *_ = small
    train, test = df.where("position % 4 <> 0"), df.where("position % 4 = 0")
    grid = [0.1, 1.0]
    got, chosen = margins.holdout_svr(train, test, grid, 3, site="site", gap=1e-5)
    got = got.toPandas().set_index("subject_id").prediction
    assert len(got) == 15 and got.notna().all() and [c["site"] for c in chosen] == [0, 1, 2]
    for s in (0, 1, 2):
        alone, best = margins.holdout_svr(train.where(f"site = {s}"), test.where(f"site = {s}"), grid, 3, gap=1e-5)
        alone = alone.toPandas().set_index("subject_id").prediction
        assert best[0]["c"] == chosen[s]["c"] and np.allclose(got[alone.index], alone, atol=0.05)
    # a site that no training row has
    strange, _ = margins.holdout_svr(train.where("site < 2"), test, grid, 3, site="site")
    assert strange.where("site = 2").agg(F.count("prediction")).first()[0] == 0


def test_inner_folds_follow_exact_positions(spark):
    """Positions that are one double apart from nothing are still dealt out in blocks."""
    rows = [(f"s{i:02d}", 2**60 + i, [float(i)], 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "subject_id string, position long, x array<double>, age double")
    placed = experiments.nested_folds(df, outer=2, inner=4).orderBy("position").toPandas()
    for o in range(2):
        inner = [r[o] for r in placed.inner if r[o] >= 0]
        assert inner == sorted(inner) and len(set(inner)) == 4
    site = margins._site_folds(df.withColumn("site", F.lit(0)), 2, 4, 42, "position").orderBy("position").toPandas()
    for o in range(2):
        inner = [r[o] for r in site.inner if r[o] >= 0]
        assert inner == sorted(inner) and len(set(inner)) == 4


def test_short_rows_have_the_same_inner_products(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(23, 300))
    x[5] = x[4]
    x[6] = 0
    frame = pd.DataFrame({"subject_id": [f"s{i}" for i in range(23)], "x": list(x), "age": rng.normal(size=23), "chunk": 1})
    df = spark.createDataFrame(frame, "subject_id string, x array<double>, age double, chunk int").repartition(3)
    monkeypatch.setattr(isometry, "BLOCK_BYTES", 8 * 64 * 5)
    short = isometry.shorten(df, chunk=64)
    got = short.rows.toPandas().set_index("subject_id").loc[frame.subject_id]
    z = np.stack(got.x)
    assert z.shape[1] == 21 and np.allclose(z @ z.T, x @ x.T) and (got.chunk == 1).all()
    # coefficients in the input's columns predict the same
    coef = rng.normal(size=z.shape[1])
    parts = short.lengthen(coef).orderBy("chunk").toPandas()
    assert np.allclose(x @ np.concatenate(parts["values"].to_list()), z @ coef)


def test_wide_fit_equals_the_narrow_one(small):
    """Sixty-four columns, of which the first five are the cohort's, in both ways."""
    df, x, *_ = small
    wide = df.withColumn("x", F.concat("x", F.transform(F.sequence(F.lit(0), F.lit(58)), lambda i: F.sin(i * F.col("position")) * 0.3)))
    short = isometry.shorten(wide).rows
    a, b = (svr.solve_problems(flagged(t), [svr.Problem(0.5)], gap=1e-6)[0][0] for t in (wide, short))
    assert np.isclose(a.objective, b.objective, rtol=1e-5)
    one = wide.select("subject_id", predict_column(a.intercept, a.coef).alias("p")).toPandas().set_index("subject_id").p
    two = short.select("subject_id", predict_column(b.intercept, b.coef).alias("p")).toPandas().set_index("subject_id").p
    assert np.allclose(one, two.loc[one.index], atol=0.05)
    ridge = [linear.ridge(moments.total(moments.collect_moments(t)), 1.0) for t in (wide, short)]
    one = wide.select("subject_id", predict_column(*ridge[0]).alias("p")).toPandas().set_index("subject_id").p
    two = short.select("subject_id", predict_column(*ridge[1]).alias("p")).toPandas().set_index("subject_id").p
    assert np.allclose(one, two.loc[one.index], atol=1e-6)


def test_two_hundred_thousand_columns(spark):
    d, n = 200_000, 50
    long = spark.range(n).withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.sin(i * (F.col("id") + 1)) / 100))
    df = long.select(F.concat(F.lit("s"), "id").alias("subject_id"), "x", (F.col("id") % 9).cast("double").alias("age"))
    short = isometry.shorten(df)
    fit = svr.solve_problems(flagged(short.rows), [svr.Problem(0.5, 0, 0.1)])[0][0]
    assert len(fit.coef) <= n and fit.gap <= 1e-3
    weights = short.lengthen(fit.coef)
    assert weights.agg(F.sum(F.size("values"))).first()[0] == d


def test_shorten_refuses_what_it_cannot_state(spark):
    kind = "subject_id string, x array<double>"
    for rows in ([("a", [1.0]), ("a", [2.0])], [("a", [1.0]), ("b", [1.0, 2.0])], [(None, [1.0])]):
        with pytest.raises(ValueError):
            isometry.shorten(spark.createDataFrame(rows, kind))
    for bad in ([None], [float("nan")], None):
        with pytest.raises(Exception, match="null or a value"):
            isometry.shorten(spark.createDataFrame([("a", bad)], kind))
    with pytest.raises(ValueError, match="more than 1"):
        isometry.shorten(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], kind), max_rows=1)
    assert isometry.shorten(spark.createDataFrame([], kind)).rows.collect() == []


def test_shorten_needs_no_arrow_setting(spark):
    """The session of a query may leave Spark's Arrow conversion of pandas tables off, as is its default."""
    plain = spark.newSession()
    plain.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    for kind, keys in (("string", ["a", "b", "c"]), ("int", [3, 1, 2]), ("timestamp", [datetime(2020, 1, 1 + i, 3) for i in range(3)])):
        rows = [(k, [1.0 * i, 2.0, 0.5]) for i, k in enumerate(keys)]
        df = plain.createDataFrame(rows, f"subject_id {kind}, x array<double>")
        got = {r["subject_id"]: np.array(r["x"]) for r in isometry.shorten(df).rows.collect()}
        assert sorted(got) == sorted(keys)
        assert all(np.isclose(got[a] @ got[b], np.dot(v, w)) for a, v in rows for b, w in rows)


def test_turned_rows_have_the_same_inner_products(spark, monkeypatch):
    """More rows than columns, copies, a column twice, a zero row; strips of a few columns."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 21))
    x[:, 7] = x[:, 3]
    x[5] = x[4]
    x[6] = 0
    frame = pd.DataFrame({"subject_id": [f"s{i}" for i in range(60)], "x": list(x), "age": rng.normal(size=60)})
    df = spark.createDataFrame(frame, "subject_id string, x array<double>, age double").repartition(3)
    monkeypatch.setattr(isometry, "STRIP_BYTES", 8 * 21 * 5)
    turned = isometry.span(df, chunk=8)
    got = turned.rows.toPandas().set_index("subject_id").loc[frame.subject_id]
    z = np.stack(got.x)
    assert z.shape[1] == 20 and np.allclose(z @ z.T, x @ x.T) and np.allclose(got.age, frame.age)
    coef = rng.normal(size=20)
    parts = turned.lengthen(coef).orderBy("chunk").toPandas()
    assert np.allclose(x @ np.concatenate(parts["values"].to_list()), z @ coef)


def test_span_of_more_rows_than_the_limit(spark):
    """As many rows as no n x n matrix may have, at sixty-four columns."""
    n = isometry.MAX_ROWS + 1
    df = spark.range(n).select(F.col("id").alias("subject_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(i * (F.col("id") + 1))).alias("x"))
    with pytest.raises(ValueError, match="more than"):
        isometry.shorten(df)
    sums = isometry.span(df).rows.select((F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("q")).agg(F.count("q"), F.sum("q")).first()
    whole = df.select(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v).alias("q")).agg(F.sum("q")).first()
    assert sums[0] == n and np.isclose(sums[1], whole[0])


def test_turn_refuses_what_it_cannot_state(spark):
    kind = "subject_id string, x array<double>"
    rows = [("a", [1.0]), ("b", [2.0]), ("c", [3.0])]
    for bad in ([*rows, ("a", [1.0])], [*rows, (None, [1.0])], [("a", []), ("b", [])]):
        with pytest.raises(ValueError):
            isometry.turn(spark.createDataFrame(bad, kind))
    for bad in ([None], [float("nan")], None, []):
        with pytest.raises(Exception, match="null|NULL|different lengths"):
            isometry.span(spark.createDataFrame([*rows, ("d", bad)], kind))
    with pytest.raises(ValueError, match="more than 1"):
        isometry.turn(spark.createDataFrame([("a", [1.0, 2.0])], kind), max_columns=1)
    assert isometry.span(spark.createDataFrame([], kind)).rows.collect() == []


def test_wide_hessians_equal_narrow_ones(small, monkeypatch):
    df = flagged(small[0])
    problems = [svr.Problem(c, 0, 0.1, loss) for c in (0.1, 1.0) for loss in ("epsilon_insensitive", "squared")]
    narrow = svr.solve_problems(df, problems, group="site", gap=1e-6)
    monkeypatch.setattr(newton, "WIDE", 3)
    wide = svr.solve_problems(df, problems, group="site", gap=1e-6)
    for site in (0, 1, 2):
        for a, b in zip(narrow[site], wide[site]):
            assert np.isclose(a.objective, b.objective, rtol=1e-5) and b.gap <= 1e-6
