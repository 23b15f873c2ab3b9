import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kohort.operators import features as prep
from kohort.operators import gram, linear, moments, neighbours, newton, process, svr, trees
from kohort.operators.sites import per_site_ridge
from kohort.plans import experiments as X
from kohort.plans import leaderboard as boards
from kohort.plans import margins


@pytest.fixture(scope="module")
def whole(small):
    return moments.total(moments.collect_moments(small[0]))


def normal_equations(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return y.mean() - x.mean(0) @ w, w


def test_moments_merge_and_subtract(small, whole):
    df, x, y, frame = small
    parts = moments.collect_moments(df, ["site"])
    rest = whole.minus(parts[(0,)])
    keep = frame.site.to_numpy() != 0
    assert rest.n == keep.sum()
    assert np.allclose(rest.mean_x, x[keep].mean(0))
    assert np.allclose(rest.sxx, np.cov(x[keep].T, bias=True) * keep.sum())
    assert np.isclose(rest.syy, ((y[keep] - y[keep].mean()) ** 2).sum())


def test_least_squares_and_ridge(small, whole):
    _, x, y, _ = small
    a = np.column_stack([np.ones(60), x])
    b, w = linear.ols(whole)
    assert np.allclose(np.r_[b, w], np.linalg.lstsq(a, y, rcond=None)[0])
    b, w = linear.ridge(whole, 10.0)
    wb, ww = normal_equations(x, y, 10.0)
    assert np.isclose(b, wb) and np.allclose(w, ww)


def test_process_equals_dual_formula(small, whole):
    _, x, y, _ = small
    p = linear.DotProductProcess(whole, 0.1)
    k = 4.0 + x @ x.T + 0.1 * np.eye(60)
    dual = np.linalg.solve(k, y)
    b, w = p.solve(2.0)
    assert np.allclose(x @ w + b, (4.0 + x @ x.T) @ dual)
    log_likelihood = -0.5 * y @ dual - 0.5 * np.linalg.slogdet(k)[1] - 30 * np.log(2 * np.pi)
    assert np.isclose(p.log_likelihood(2.0), log_likelihood)
    best = p.best_scale()
    assert p.log_likelihood(best) >= max(p.log_likelihood(best * f) for f in (0.8, 1.25)) - 1e-9


def test_elastic_net_optimality(small, whole):
    _, x, y, _ = small
    w = linear.coordinate_descent(whole, 0.3, 0.7, tol=1e-12)
    xc, yc = x - x.mean(0), y - y.mean()
    slope = xc.T @ (yc - xc @ w) / 60 - 0.3 * 0.3 * w
    for s, c in zip(slope, w):
        assert abs(s - 0.21 * np.sign(c)) < 1e-6 if c else abs(s) <= 0.21 + 1e-6


def test_lasso_cv_picks_from_path(small):
    from kohort.operators.folds import kfold_contiguous

    parts = moments.collect_moments(kfold_contiguous(small[0], "position", "subject_id", 3), ["fold"])
    alpha, (_, w) = linear.lasso_cv([parts[k] for k in sorted(parts)], normalize=True)
    assert alpha > 0 and abs(w[0] - 3.0) < 0.6


@pytest.mark.parametrize("c", [2.0**-6, 0.5, 2.0])
def test_svr_duality_gap(small, c):
    df, x, y, _ = small
    b, w = svr.linear_svr(df, c, 0.1)
    r = x @ w + b - y
    primal = 0.5 * w @ w + c * np.maximum(np.abs(r) - 0.1, 0).sum()

    # any other point is no better, up to the smoothing
    rng = np.random.default_rng(0)
    for _ in range(200):
        dw, db = rng.normal(size=5) * 0.1, rng.normal() * 0.1
        other = np.abs(x @ (w + dw) + b + db - y)
        value = 0.5 * (w + dw) @ (w + dw) + c * np.maximum(other - 0.1, 0).sum()
        assert value >= primal * (1 - 5e-3)


def test_squared_loss_is_stationary(small):
    df, x, y, _ = small
    b, w = svr.linear_svr(df, 1.0, 0.2, "squared", gap=1e-10)
    r = x @ w + b - y
    slope = 2 * np.sign(r) * np.maximum(np.abs(r) - 0.2, 0)
    assert np.abs(w + x.T @ slope).max() < 1e-3 and abs(slope.sum()) < 1e-3


def test_site_models_equal_separate_fits(small):
    df, x, y, frame = small
    got = per_site_ridge(df, 1.0).toPandas().set_index("subject_id").prediction
    for s in (0, 1, 2):
        mine = (frame.site == s).to_numpy()
        b, w = normal_equations(x[mine], y[mine], 1.0)
        assert np.allclose(got[frame.subject_id[mine]], x[mine] @ w + b)


def test_site_svr_equals_separate_nested_svr(small):
    df, *_ = small
    options = {"gap": 1e-5}
    grid = [2.0**-4, 1.0]
    both = margins.per_site_svr(df, grid, 3, 2, **options).toPandas().set_index("subject_id").prediction
    assert both.notna().all() and len(both) == 60
    alone, _ = margins.nested_svr(df.where("site = 0"), grid, 3, 2, **options)
    alone = alone.toPandas().set_index("subject_id").prediction
    assert np.allclose(both[alone.index], alone, atol=0.05)


def test_classifier_separates_clear_classes(spark):
    rng = np.random.default_rng(3)
    label = np.repeat([20, 30, 40], 30)
    x = rng.normal(size=(90, 2)) * 0.3 + np.array([[0, 0], [3, 0], [0, 3]])[np.arange(90) // 30]
    frame = pd.DataFrame({"subject_id": [f"s{i}" for i in range(90)], "x": list(x), "age": label + 0.5})
    df = spark.createDataFrame(frame, "subject_id string, x array<double>, age double")
    out = margins.weighted_classifier(df, 1.0, 3).toPandas()
    assert (out.label == out.predicted).mean() > 0.97


def test_gram_blocks_and_chunks(small):
    df, x, _, frame = small
    want = pd.DataFrame(x @ x.T, index=frame.subject_id, columns=frame.subject_id)
    for options in ({}, {"block_rows": 7}, {"block_rows": 16, "chunk": 2}):
        got = gram.gram_matrix(df, **options).toPandas()
        assert len(got) == 3600
        assert np.allclose(got.pivot(index="id_a", columns="id_b", values="dot").loc[want.index, want.columns], want)
    site = gram.gram_matrix(df, within="site", block_rows=6).toPandas()
    assert len(site) == 35**2 + 20**2 + 5**2
    rect = gram.gram_rectangle(df.where("site = 2"), df.where("site <> 2"), block_rows=9, chunk=3).toPandas()
    assert len(rect) == 5 * 55
    wanted = [want.loc[a, b] for a, b in zip(rect["id_a"], rect["id_b"])]
    assert np.allclose(rect["dot"].to_numpy(), wanted)


def test_gram_collapses_copies(small):
    df, *_ = small
    assert gram.gram_matrix(df.unionByName(df), block_rows=16).count() == 3600


def test_fused_and_site_grams_are_sums(small):
    df, x, _, frame = small
    k = x @ x.T + x[:, ::-1] @ x[:, ::-1].T + 100.0 * (frame.site.to_numpy()[:, None] == frame.site.to_numpy())
    both = gram.with_site(gram.fused(df, df.withColumn("x", F.reverse("x"))), [0, 1, 2], 10.0)
    got = gram.gram_matrix(both).toPandas().pivot(index="id_a", columns="id_b", values="dot")
    assert np.allclose(got.loc[frame.subject_id, frame.subject_id], k)


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_neighbours_against_brute_force(small, p, weights):
    df, x, y, frame = small
    got = neighbours.knn_regress(df.where("position < 20"), df.where("position >= 10"), 4, p, weights, block_rows=8)
    got = got.toPandas().set_index("subject_id").prediction
    for i in range(20):
        gap = np.abs(x[10:] - x[i])
        d = gap.sum(1) if p == 1 else np.sqrt((gap**2).sum(1))
        near = np.argsort(d, kind="stable")[:4]
        if weights == "uniform":
            want = y[10:][near].mean()
        elif d[near[0]] == 0:
            want = y[10:][near[0]]
        else:
            want = np.average(y[10:][near], weights=1 / d[near])
        assert np.isclose(got[f"s{i:03d}"], want)


def test_scaling_uses_training_rows_only(small):
    df, x, y, _ = small
    scales = X.training_scales(df.withColumn("fold", F.col("position") % 3), 3)
    for f in range(3):
        train = x[np.arange(60) % 3 != f]
        q25, q50, q75 = np.quantile(train, [0.25, 0.5, 0.75], axis=0)
        assert np.allclose(scales[f].center, q50)
        assert np.allclose(np.diag(scales[f].weights), 1 / (q75 - q25))


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([([5.0, float(i)],) for i in range(9)], "x array<double>")
    out = prep.robust_scale(df, prep.collect_robust(df)).collect()
    assert all(r["x"][0] == 0.0 for r in out)


def test_out_of_fold_predictions_do_not_see_their_fold(small):
    df, *_ = small
    fit = X.Pipeline(lambda m: linear.ridge(m, 1.0))
    base = X.cross_validate(df, fit, 5, scale=True).toPandas().set_index("subject_id")
    moved = df.join(X.cross_validate(df, fit, 5).select("subject_id", "fold"), "subject_id")
    moved = moved.withColumn("age", F.when(F.col("fold") == 2, F.col("age") + 100).otherwise(F.col("age")))
    again = X.cross_validate(moved.drop("fold"), fit, 5, scale=True).toPandas().set_index("subject_id")
    held = base.index[base.fold == 2]
    assert np.allclose(base.prediction[held], again.prediction[held])
    assert not np.allclose(base.prediction.drop(held), again.prediction.drop(held.tolist()))


def test_pipeline_steps_fold_into_coefficients(small, whole):
    _, x, y, _ = small
    scale = prep.Affine(np.median(x, 0), np.diag(1 / np.ptp(x, 0)))
    b, w = X.Pipeline(lambda m: linear.ridge(m, 2.0), [X.pca_step(3)])(whole, scale)
    z = (x - np.median(x, 0)) / np.ptp(x, 0)
    zc = z - z.mean(0)
    axes = np.linalg.svd(zc, full_matrices=False)[2][:3].T
    t = zc @ axes
    tb, tw = normal_equations(t, y, 2.0)
    assert np.allclose(x @ w + b, t @ tw + tb)


def test_nested_search_against_loops(small):
    df, x, y, frame = small
    params = [0.1, 10.0, 1000.0]
    out, chosen = X.nested_cv(df, params, lambda a: X.Pipeline(lambda m: linear.ridge(m, a)), 4, 3)
    got = out.toPandas().set_index("subject_id").loc[frame.subject_id]
    fold = got.fold.to_numpy()
    for o in range(4):
        train = np.flatnonzero(fold != o)
        maes = []
        for a in params:
            errors = np.concatenate(
                [
                    np.abs(y[h] - x[h] @ w - b)
                    for h in np.array_split(train, 3)
                    for b, w in [normal_equations(x[np.setdiff1d(train, h)], y[np.setdiff1d(train, h)], a)]
                ]
            )
            maes.append(errors.mean())
        assert chosen[o]["param"] == params[int(np.argmin(maes))]
        assert np.isclose(chosen[o]["mae"], min(maes))
        b, w = normal_equations(x[train], y[train], chosen[o]["param"])
        assert np.allclose(got.prediction[fold == o], x[fold == o] @ w + b)


def test_projection_and_selection(small, whole):
    df, x, y, _ = small
    fitted, share = prep.fit_pca(whole, 0.9)
    assert share[:-1].sum() <= 0.9 < share.sum() + 1e-12
    full, _ = prep.fit_pca(whole, 5)
    z = np.array([r["x"] for r in full.apply(df.select("x")).collect()])
    assert np.allclose(np.sort((z**2).sum(1)), np.sort(((x - x.mean(0)) ** 2).sum(1)))
    f = prep.column_scores(whole)["f"]
    r = np.array([np.corrcoef(c, y)[0, 1] for c in x.T])
    assert np.allclose(f, r**2 / (1 - r**2) * 58)
    assert prep.percentile_mask(whole, 40).sum() == 2
    assert set(np.flatnonzero(prep.percentile_mask(whole, 40))) == set(np.argsort(f)[-2:])


def test_select_fwe_keeps_strong_columns(small):
    kept = prep.select_fwe(small[0], 0.05).first()["x"]
    assert 1 <= len(kept) < 5


def test_impute_median(spark):
    df = spark.createDataFrame([([1.0, None],), ([None, 4.0],), ([3.0, 6.0],)], "x array<double>")
    out = prep.impute_median(df, prep.column_medians(df)).collect()
    assert sorted(tuple(r["x"]) for r in out) == [(1.0, 5.0), (2.0, 4.0), (3.0, 6.0)]


def test_oversample_to_largest_class(small):
    df = small[0].withColumn("label", F.col("site")).select("subject_id", "label")
    out = prep.oversample_minority(df)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 35, 1: 20, 2: 35}
    assert out.where("copy > 0 AND label <> 2").count() == 0


def test_kernel_features(small):
    df, x, _, frame = small
    z = np.array([r["x"] for r in prep.rbf_features(df, 0.05, 4000).orderBy("subject_id").collect()])
    exact = prep.kernel("rbf", x, x, 0.05)
    assert np.abs(z @ z.T - exact).max() < 0.1
    for name in ("rbf", "linear", "cosine", "laplacian", "polynomial", "sigmoid"):
        got = prep.nystroem(df, name, 0.05, 6).select("x").collect()
        assert len(got) == 60 and len(got[0]["x"]) == 6
    # every row a landmark: the approximation is exact
    full = np.array([r["x"] for r in prep.nystroem(df, "rbf", 0.05, 60).orderBy("subject_id").collect()])
    assert np.allclose(full @ full.T, exact, atol=1e-6)


def test_chi_square_kernels():
    a = np.array([[1.0, 2.0], [0.0, 0.0]])
    assert np.allclose(prep.kernel("additive_chi2", a, a, 1.0), [[0, -3], [-3, 0]])
    assert np.allclose(prep.kernel("chi2", a, a, 0.5), np.exp(0.5 * np.array([[0, -3], [-3, 0]])))


@pytest.mark.parametrize("linkage", ["ward", "complete", "average"])
@pytest.mark.parametrize("affinity", ["euclidean", "l1", "cosine"])
def test_agglomeration_joins_copies_of_columns(small, linkage, affinity):
    df = small[0].withColumn("x", F.concat("x", F.transform("x", lambda v: v * 1.001)))
    out = prep.feature_agglomeration(df, 5, linkage, affinity).orderBy("subject_id").first()["x"]
    base = small[1][0]
    assert np.allclose(sorted(out), sorted(base * 1.0005))


def test_independent_components_are_white(small):
    out, _ = prep.fast_ica(small[0], 3, max_iter=15)
    z = np.array([r["x"] for r in out.select("x").collect()])
    assert np.allclose(np.cov(z.T, bias=True), np.eye(3), atol=1e-6)


def test_stacked_feature_layout(small, whole):
    row = prep.stack_feature(small[0]).where("position = 0").first()["x"]
    b, w = linear.ols(whole)
    x0 = small[1][0]
    assert np.allclose(row, np.r_[x0 @ w + b, x0, x0])


def test_rbf_process_is_close_to_the_dual(small):
    df, x, y, _ = small
    gamma, (b, w) = process.gpr_rbf(df, 1.0, (0.01, 0.05), components=3000)
    z = np.array([r["x"] for r in prep.rbf_features(df, gamma, 3000).orderBy("subject_id").collect()])
    k = prep.kernel("rbf", x, x, gamma)
    exact = k @ np.linalg.solve(k + np.eye(60), y)
    assert b == 0.0 and np.abs(z @ w - exact).mean() < 1.5


def test_forest_is_bounded_and_repeatable(small):
    df, _, y, _ = small
    one = trees.predict(trees.random_forest(df, 5, 0.45, 5), df).orderBy("subject_id").toPandas().prediction
    two = trees.predict(trees.random_forest(df, 5, 0.45, 5), df).orderBy("subject_id").toPandas().prediction
    assert np.allclose(one, two) and one.between(y.min(), y.max()).all()


def test_leaderboard_keeps_failures(small):
    broken = boards.Candidate("none", 2, X.Pipeline(linear.ols, [X.pca_step(0)]))
    good = [c for c in boards.default_candidates() if c.name in ("least_squares", "axes_2+least_squares", "tree_3")]
    rows = {r["candidate"]: r for r in boards.leaderboard(small[0], [*good, broken], 3).collect()}
    assert rows["none"]["score"] == float("-inf") and "ValueError" in rows["none"]["error"]
    cv = X.cross_validate(small[0], X.Pipeline(linear.ols), 3)
    mae = X.fold_errors(cv).agg(F.avg("mae")).first()[0]
    assert np.isclose(rows["least_squares"]["score"], -mae)
    front = boards.holdout_leaderboard(small[0], good, k=3).collect()
    assert len(front) >= 1 and all(r["test_mae"] > 0 for r in front)


def test_open_fits_raise(small):
    with pytest.raises(newton.NotConverged, match="1 of 1 problems"):
        svr.linear_svr(small[0], 1.0, 0.1, max_passes=3)


def test_queries_try_the_whole_grids(monkeypatch):
    from kohort.catalog import learning

    seen = {}
    monkeypatch.setattr(learning.V, "features", lambda spark, d: None)
    monkeypatch.setattr(learning, "predicted", lambda f, model: None)
    monkeypatch.setattr(learning, "rbf_features", lambda f, gamma: None)
    monkeypatch.setattr(learning.margins, "per_site_svr", lambda f, *a, **o: seen.update(site=(a, o)))
    monkeypatch.setattr(learning.svr, "linear_svr", lambda f, *a, **o: seen.update(linear=(a, o)))
    monkeypatch.setattr(learning.process, "gpr_rbf", lambda f, *a, **o: seen.update(rbf=(a, o)) or (0.5, None))
    for name in ("per_site_svr", "linear_svr", "gpr_rbf"):
        getattr(learning, name)(None, None)
    assert seen["site"] == (([2.0**e for e in range(-6, 2)], 5, 3), {})
    assert seen["linear"] == ((0.5, 0.1), {}) and seen["rbf"] == ((0.1,), {})
