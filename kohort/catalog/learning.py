"""Regressors, classifiers and experiments."""

from pyspark.sql import functions as F

from ..operators import linear, process, svr, trees
from ..operators import moments as mom
from ..operators.scoring import predict_column
from ..operators.features import rbf_features
from ..operators.isometry import span
from ..plans import experiments as X
from ..plans import margins
from . import views as V
from .registry import query


def whole(spark, d):
    return mom.total(mom.collect_moments(V.features(spark, d)))


def predicted(df, model):
    return df.select("subject_id", "age", V.r6(predict_column(*model), "prediction"))


Z = """SELECT site, [CAST(1 AS DOUBLE), x[1], x[2], x[3], x[4], age] AS z FROM features"""


@query(
    "moments",
    """SELECT site, i, j, round(sum(z[i + 1] * z[j + 1]), 6) AS value FROM z,
         (SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j FROM range(6) a, range(6) b WHERE a.range <= b.range)
       GROUP BY site, i, j""",
    "features",
    extra={"z": Z},
)
def moments(spark, d):
    four = V.features(spark, d).withColumn("x", F.slice("x", 1, 4))
    out = mom.cross_products(four, ["site"])
    return out.select("site", "i", "j", V.r6("value", "value"))


@query("ols")
def ols(spark, d):
    return predicted(V.features(spark, d), linear.ols(whole(spark, d)))


ALPHAS = [1.0, 10.0, 100.0]


@query(
    "ridge",
    """SELECT alpha, round(my - slope * mx, 6) AS intercept, round(slope, 6) AS slope FROM (
         SELECT alpha, my, mx, sxy / (sxx + alpha) AS slope FROM
           (SELECT avg(x[1]) AS mx, avg(age) AS my, regr_sxx(age, x[1]) AS sxx, regr_sxy(age, x[1]) AS sxy FROM features),
           (VALUES (CAST(1 AS DOUBLE)), (CAST(10 AS DOUBLE)), (CAST(100 AS DOUBLE))) a(alpha))""",
    "features",
)
def ridge(spark, d):
    one = V.features(spark, d).withColumn("x", F.slice("x", 1, 1))
    m = mom.total(mom.collect_moments(one))
    rows = []
    for alpha in ALPHAS:
        intercept, coef = linear.ridge(m, alpha)
        rows.append((alpha, round(intercept, 6), round(float(coef[0]), 6)))
    return spark.createDataFrame(rows, "alpha double, intercept double, slope double")


@query("ridge_many")
def ridge_many(spark, d):
    return predicted(V.features(spark, d), linear.ridge(whole(spark, d), 1.0))


def contiguous_parts(spark, d, k):
    from ..operators.folds import kfold_contiguous

    parts = mom.collect_moments(kfold_contiguous(V.features(spark, d), "position", "subject_id", k), ["fold"])
    return [parts[key] for key in sorted(parts)]


@query("elastic_net_cv")
def elastic_net_cv(spark, d):
    _, model = linear.elastic_net_cv(contiguous_parts(spark, d, 3), 0.5)
    return predicted(V.features(spark, d), model)


@query("lasso_cv")
def lasso_cv(spark, d):
    _, model = linear.lasso_cv(contiguous_parts(spark, d, 3), normalize=True)
    return predicted(V.features(spark, d), model)


@query("gpr_linear")
def gpr_linear(spark, d):
    return predicted(V.features(spark, d), linear.gpr_linear(whole(spark, d), 0.1))


@query("gpr_rbf")
def gpr_rbf(spark, d):
    f = V.features(spark, d)
    gamma, model = process.gpr_rbf(f, 0.1)
    return predicted(rbf_features(f, gamma), model)


@query("linear_svr")
def linear_svr(spark, d):
    f = V.features(spark, d)
    return predicted(f, svr.linear_svr(f, 0.5, 0.1))


@query("svr_grid_liblinear")
def svr_grid_liblinear(spark, d):
    out = margins.svr_grid(V.features(spark, d), margins.linear_grid())
    rows = [(g["param_pos"], g["loss"], g["dual"], g["tol"], g["c"], g["epsilon"], round(g["mae"], 6), g["gap"]) for g in out]
    return spark.createDataFrame(rows, "param_pos int, loss string, dual boolean, tol double, c double, epsilon double, mae double, gap double")


@query("nested_svr")
def nested_svr(spark, d):
    return margins.nested_svr(V.features(spark, d), margins.C_GRID, 5, 5)[0]


@query("holdout_svr")
def holdout_svr(spark, d):
    f = V.features(spark, d)
    return margins.holdout_svr(f.where("position % 4 <> 0"), f.where("position % 4 = 0"))[0]


@query("holdout_svr_per_site")
def holdout_svr_per_site(spark, d):
    f = V.features(spark, d)
    return margins.holdout_svr(f.where("position % 4 <> 0"), f.where("position % 4 = 0"), site="site")[0]


@query("linear_svr_wide")
def linear_svr_wide(spark, d):
    """Rows of 4,160 values, each feature vector with all its pairwise products: fitted in the span of the subjects or of the columns."""
    products = F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: a * b)))
    short = span(V.features(spark, d).withColumn("x", F.concat("x", products))).rows
    return predicted(short, svr.linear_svr(short, 0.5, 0.1))


@query("weighted_classifier")
def weighted_classifier(spark, d):
    return margins.weighted_classifier(V.features(spark, d), c=1.0, k=5, gap=1e-2)


@query("decision_tree")
def decision_tree(spark, d):
    f = V.features(spark, d)
    return trees.predict(trees.decision_tree(f, 5, 5), f).select("subject_id", "age", "prediction")


@query("random_forest")
def random_forest(spark, d):
    f = V.features(spark, d)
    return trees.predict(trees.random_forest(f, 100, 0.45, 15, max_depth=6), f).select("subject_id", "age", "prediction")


@query("per_site_ridge")
def per_site_ridge(spark, d):
    from ..operators.sites import per_site_ridge as fit

    return fit(V.features(spark, d), 1.0).select("subject_id", "site", "age", V.r6("prediction", "prediction"))


@query("per_site_svr")
def per_site_svr(spark, d):
    return margins.per_site_svr(V.features(spark, d), margins.C_GRID, 5, 3)


# ---------------------------------------------------------------- experiments


def ridge_pipeline(alpha):
    return X.Pipeline(lambda m: linear.ridge(m, alpha))


@query("cross_validate")
def cross_validate(spark, d):
    fit = X.Pipeline(lambda m: linear.gpr_linear(m, 0.1, 1.0))
    out = X.cross_validate(V.features(spark, d), fit, scale=True)
    return out.select("subject_id", "age", "fold", V.r6("prediction", "prediction"))


# the same path with one feature, where SQL can state the fit
FOLDED = """SELECT subject_id, age, x[1] AS v, CAST(ntile(5) OVER (ORDER BY md5('42:' || subject_id), subject_id) - 1 AS INTEGER)
    AS fold FROM features"""


@query(
    "cross_validate_line",
    """SELECT f.subject_id, f.age, f.fold, round(my - mx * sxy / (sxx + 1) + f.v * sxy / (sxx + 1), 6) AS prediction
       FROM folded f JOIN (SELECT h.fold, avg(t.v) AS mx, avg(t.age) AS my, regr_sxx(t.age, t.v) AS sxx,
         regr_sxy(t.age, t.v) AS sxy FROM (SELECT DISTINCT fold FROM folded) h JOIN folded t ON t.fold <> h.fold
         GROUP BY h.fold) m ON m.fold = f.fold""",
    "features",
    extra={"folded": FOLDED},
)
def cross_validate_line(spark, d):
    one = V.features(spark, d).withColumn("x", F.slice("x", 1, 1))
    out = X.cross_validate(one, ridge_pipeline(1.0))
    return out.select("subject_id", "age", "fold", V.r6("prediction", "prediction"))


@query("grid_search")
def grid_search(spark, d):
    params = [(alpha, name) for name in ("ridge", "gpr") for alpha in (1.0, 0.1, 0.15, 0.01, 0.015)]

    def build(p):
        alpha, name = p
        return ridge_pipeline(alpha) if name == "ridge" else X.Pipeline(lambda m: linear.gpr_linear(m, alpha))

    out = X.grid_search(V.features(spark, d), params, build)
    rows = [(g["param_pos"], g["param"][1], g["param"][0], round(g["mae"], 6)) for g in out]
    return spark.createDataFrame(rows, "param_pos int, model string, alpha double, mae double")


@query(
    "grid_search_line",
    """SELECT CAST(alpha AS DOUBLE) AS alpha, round(sum(error) / count(*), 6) AS mae FROM (
         SELECT m.alpha, abs(f.age - (my + (f.v - mx) * sxy / (sxx + m.alpha))) AS error
         FROM folded f JOIN (SELECT h.fold, a.alpha, avg(t.v) AS mx, avg(t.age) AS my, regr_sxx(t.age, t.v) AS sxx,
           regr_sxy(t.age, t.v) AS sxy FROM (SELECT DISTINCT fold FROM folded) h JOIN folded t ON t.fold <> h.fold,
           (VALUES (1), (10), (100)) a(alpha) GROUP BY h.fold, a.alpha) m ON m.fold = f.fold)
       GROUP BY alpha""",
    "features",
    extra={"folded": "SELECT age, x[1] AS v, ntile(5) OVER (ORDER BY position) - 1 AS fold FROM features"},
)
def grid_search_line(spark, d):
    one = V.features(spark, d).withColumn("x", F.slice("x", 1, 1))
    rows = [(g["param"], round(g["mae"], 6)) for g in X.grid_search(one, ALPHAS, ridge_pipeline)]
    return spark.createDataFrame(rows, "alpha double, mae double")


@query("nested_cv")
def nested_cv(spark, d):
    out, _ = X.nested_cv(V.features(spark, d), ALPHAS, ridge_pipeline)
    return out.select("subject_id", "age", "fold", V.r6("prediction", "prediction"))


@query("refit_full")
def refit_full(spark, d):
    f = V.features(spark, d)
    best = X.best_of(X.grid_search(f, ALPHAS, ridge_pipeline))
    intercept, coef = X.refit_full(f, ridge_pipeline(best["param"]), scale=True)
    rows = [(-1, round(intercept, 6)), *[(j, round(float(c), 6)) for j, c in enumerate(coef)]]
    return spark.createDataFrame(rows, "term int, value double")


@query("fit_predict_holdout")
def fit_predict_holdout(spark, d):
    f = V.features(spark, d)
    out = X.fit_predict_holdout(f.where("position % 4 <> 0"), f.where("position % 4 = 0"), ridge_pipeline(1.0))
    return out.select("subject_id", V.r6("prediction", "prediction"))


@query(
    "fit_predict_holdout_line",
    """SELECT f.subject_id, round(my + (f.x[1] - mx) * sxy / (sxx + 1), 6) AS prediction FROM features f,
       (SELECT avg(x[1]) AS mx, avg(age) AS my, regr_sxx(age, x[1]) AS sxx, regr_sxy(age, x[1]) AS sxy FROM features
        WHERE position % 4 <> 0) WHERE position % 4 = 0""",
    "features",
)
def fit_predict_holdout_line(spark, d):
    f = V.features(spark, d).withColumn("x", F.slice("x", 1, 1))
    out = X.fit_predict_holdout(f.where("position % 4 <> 0"), f.where("position % 4 = 0"), ridge_pipeline(1.0))
    return out.select("subject_id", V.r6("prediction", "prediction"))


@query(
    "per_site_ridge_line",
    """SELECT f.subject_id, f.site, f.age, round(my + (f.x[1] - mx) * sxy / (sxx + 1), 6) AS prediction FROM features f JOIN
       (SELECT site, avg(x[1]) AS mx, avg(age) AS my, regr_sxx(age, x[1]) AS sxx, regr_sxy(age, x[1]) AS sxy FROM features
        GROUP BY site) m ON m.site = f.site""",
    "features",
)
def per_site_ridge_line(spark, d):
    from ..operators.sites import per_site_ridge as fit

    one = V.features(spark, d).withColumn("x", F.slice("x", 1, 1))
    return fit(one, 1.0).select("subject_id", "site", "age", V.r6("prediction", "prediction"))


# outer folds by hash, inner folds contiguous among the outer training rows, alpha by weighted inner error
NESTED = {
    "folded": FOLDED.replace("SELECT subject_id, age,", "SELECT subject_id, age, position,"),
    "heads": "SELECT DISTINCT fold AS o FROM folded",
    "training": """SELECT h.o, t.*, ntile(5) OVER (PARTITION BY h.o ORDER BY t.position) AS i
        FROM heads h JOIN folded t ON t.fold <> h.o""",
    "grid": "SELECT * FROM (VALUES (1), (10), (100)) a(alpha)",
    "inner_fits": """SELECT o, held, avg(v) AS mx, avg(age) AS my, regr_sxx(age, v) AS sxx, regr_sxy(age, v) AS sxy
        FROM training JOIN (SELECT range AS held FROM range(1, 6)) r ON r.held <> training.i GROUP BY o, held""",
    "scores": """SELECT t.o, alpha, avg(abs(t.age - (my + (t.v - mx) * sxy / (sxx + alpha)))) AS mae
        FROM training t JOIN inner_fits m ON m.o = t.o AND m.held = t.i, grid GROUP BY t.o, alpha""",
    "best": "SELECT o, arg_min(alpha, mae) AS alpha FROM scores GROUP BY o",
    "fits": """SELECT o, avg(v) AS mx, avg(age) AS my, regr_sxx(age, v) AS sxx, regr_sxy(age, v) AS sxy
        FROM training GROUP BY o""",
}


@query(
    "nested_cv_line",
    """SELECT f.subject_id, f.age, f.fold, round(my + (f.v - mx) * sxy / (sxx + b.alpha), 6) AS prediction
       FROM folded f JOIN fits m ON m.o = f.fold JOIN best b ON b.o = f.fold""",
    "features",
    extra=NESTED,
)
def nested_cv_line(spark, d):
    one = V.features(spark, d).withColumn("x", F.slice("x", 1, 1))
    out, _ = X.nested_cv(one, ALPHAS, ridge_pipeline)
    return out.select("subject_id", "age", "fold", V.r6("prediction", "prediction"))
