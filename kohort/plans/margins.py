"""Support vector studies: parameter grids, nested search, hold-out prediction, per-site models, weighted classification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.arrays import list_array, matrix, sum_arrays, vector
from ..operators.folds import fold_starts, kfold_contiguous, kfold_shuffled
from ..operators.ranks import attach, order_statistics
from ..operators.scoring import absolute_errors, predict_by
from ..operators.stats import balanced_accuracy, class_weights
from ..operators.svr import Problem, codes, fit_one_vs_one, fit_problems, solve_problems, vote
from .experiments import flag_columns, nested_folds, training_sets, weighted_scores

#: fixed values: the C tried by every study, and the grid of the linear solver's search
C_GRID = [2.0**-6, 2.0**-5, 2.0**-4, 2.0**-3, 2.0**-2, 2.0**-1, 2.0**0, 2.0**1]
EPSILONS = [1e-4, 1e-3, 1e-2, 1e-1, 1.0]
TOLERANCES = [1e-5, 1e-4, 1e-3, 1e-2, 1e-1]
LOSSES = ["epsilon_insensitive", "squared"]


def linear_grid() -> list[dict]:
    """The linear solver's search space. ``dual`` and ``tol`` choose how it computes the optimum, not the optimum."""
    return [
        {"loss": loss, "dual": dual, "tol": tol, "c": c, "epsilon": epsilon}
        for loss in LOSSES for dual in (True, False) for tol in TOLERANCES for c in C_GRID for epsilon in EPSILONS
    ]


def fold_flags(rows: DataFrame, k: int, everything: bool = False) -> DataFrame:
    """0/1 arrays ``train`` and ``held`` over folds 0..k-1; ``everything`` adds a training set of all rows."""
    more = [F.lit(1).cast("tinyint")] if everything else []
    return rows.withColumns(
        {
            "train": F.array(*[(F.col("fold") != f).cast("tinyint") for f in range(k)], *more),
            "held": F.array(*[(F.col("fold") == f).cast("tinyint") for f in range(k)]),
        }
    )


def svr_grid(
    df: DataFrame, grid: list[dict], k: int = 5, position: str = "position", **options
) -> list[dict]:
    """MAE and widest duality gap of every parameter combination over k contiguous folds; all fits share their passes.

    Grid entries may hold ``c``, ``epsilon``, ``loss`` and ``penalise_intercept``; entries that differ in nothing else have one
    optimum and share its fits, as every fit here is closed by the common ``gap`` option.
    """
    rows = fold_flags(kfold_contiguous(df, position, "subject_id", k), k)

    def fit_of(g: dict) -> tuple:
        return g["c"], g.get("epsilon", 0.0), g.get("loss", "epsilon_insensitive"), g.get("penalise_intercept", True)

    distinct = list(dict.fromkeys(map(fit_of, grid)))
    problems = [Problem(c, f, epsilon, loss, penalise) for c, epsilon, loss, penalise in distinct for f in range(k)]
    solutions = solve_problems(rows, problems, **options)[0]
    errors, counts = absolute_errors(rows, [(s.intercept, s.coef) for s in solutions], [q.rows for q in problems])
    scores = dict(zip(distinct, weighted_scores(errors, counts, k)))
    gaps = dict(zip(distinct, np.array([s.gap for s in solutions]).reshape(-1, k).max(1)))
    return [{"param_pos": i, **g, "mae": float(scores[fit_of(g)]), "gap": float(gaps[fit_of(g)])} for i, g in enumerate(grid)]


def nested_svr(
    df: DataFrame, grid: list[float] = C_GRID, outer: int = 5, inner: int = 5, seed: int = 42, epsilon: float = 0.1, **options
) -> tuple[DataFrame, list[dict]]:
    """Out-of-fold predictions with C chosen inside each outer training set, and the choices with their inner error."""
    rows = flag_columns(nested_folds(df, outer=outer, inner=inner, seed=seed), outer, inner)
    names = training_sets(outer, inner)
    tried = [
        Problem(c, names.index((o, i)), epsilon) for o in range(outer) for c in grid for i in range(inner)
    ]
    models = fit_problems(rows, tried, **options)[0]
    errors, counts = absolute_errors(rows, models, [q.rows for q in tried])
    scores = weighted_scores(errors, counts, inner).reshape(outer, len(grid))
    best = scores.argmin(1)
    final = fit_problems(rows, [Problem(grid[best[o]], o, epsilon) for o in range(outer)], **options)[0]
    chosen = [{"fold": o, "c": grid[best[o]], "mae": float(scores[o, best[o]])} for o in range(outer)]
    return predict_by(rows.select("subject_id", "age", "fold", "x"), dict(enumerate(final)), "fold").drop("x"), chosen


def holdout_svr(
    train: DataFrame, test: DataFrame, grid: list[float] = C_GRID, k: int = 5, epsilon: float = 0.1, position: str = "position",
    site: str | None = None, **options,
) -> tuple[DataFrame, list[dict]]:
    """Predictions of ``test`` by a fit of all of ``train`` with C chosen over k contiguous folds of it.

    With ``site`` every site has folds, a choice and a fit of its own, all sites in the same passes; test rows of a site without
    training rows have no prediction. Returns (subject_id, site, prediction) and the choice of each site.
    """
    by = [site] if site else []
    rows = fold_flags(kfold_contiguous(train, position, "subject_id", k, by), k, everything=True).persist()
    try:
        # an ungrouped study is one group
        keyed = rows.withColumn("g", F.col(site) if site else F.lit(0))
        tried = [Problem(c, f, epsilon) for c in grid for f in range(k)]
        models = fit_problems(keyed, tried, group="g", **options)
        levels = list(models)
        errors, counts = group_errors(keyed, [m for v in levels for m in models[v]], [q.rows for q in tried], levels, "g")
        chosen, final = [], []
        for j, v in enumerate(levels):
            scores = errors[j].reshape(-1, k).sum(1) / np.maximum(counts[j].reshape(-1, k).sum(1), 1)
            best = int(scores.argmin())
            chosen.append({"site": v, "c": grid[best], "mae": float(scores[best])})
            final.append([Problem(grid[best], k, epsilon)])
        fits = fit_problems(keyed, final, group="g", **options)
    finally:
        rows.unpersist()
    kept = ["subject_id", *by, "x"]
    scored = test.select(*kept).withColumn("_g", F.col(site) if site else F.lit(0))
    out = predict_by(scored, {v: fits[v][0] for v in levels}, "_g").drop("x", "_g")
    return out, chosen


def _site_folds(df: DataFrame, outer: int, inner: int, seed: int, position: str) -> DataFrame:
    """Nested folds restarted inside each site."""
    rows = kfold_shuffled(df, "subject_id", outer, seed, by=["site"])
    training = rows.select("site", position, "subject_id", "fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("o"))
    training = training.where(F.col("o") != F.col("fold")).withColumn("_exact", F.struct(F.col(position).alias("p"), F.col("subject_id").alias("i")))
    cuts = order_statistics(training, position, lambda n: fold_starts(n, inner), ["site", "o"], tie="_exact")
    cuts = cuts.groupBy("site").agg(F.collect_list(F.struct("o", F.struct("value", "tie").alias("at"))).alias("cuts"))
    # a site of few rows has no cut and keeps its rows
    placed = attach(rows, cuts, ["site"], "cuts", "left")
    none = F.array().cast(cuts.schema["cuts"].dataType)
    placed = placed.withColumn("cuts", F.coalesce("cuts", none))
    exact = F.struct(F.col(position).alias("p"), F.col("subject_id").alias("i"))
    me = F.struct(F.col(position).cast("double").alias("value"), exact.alias("tie"))

    def passed(o: int):
        return F.size(F.filter("cuts", lambda c: (c["o"] == o) & (c["at"] <= me)))

    inner_folds = [F.when(F.col("fold") == o, F.lit(-1)).otherwise(passed(o)) for o in range(outer)]
    return placed.withColumn("inner", F.array(*inner_folds)).drop("cuts")


def per_site_svr(
    df: DataFrame, grid: list[float] = C_GRID, outer: int = 5, inner: int = 3, seed: int = 42, epsilon: float = 0.1,
    position: str = "position", **options,
) -> DataFrame:
    """One nested SVR per site, all sites in the same passes: (subject_id, site, age, fold, prediction).

    A site never becomes one task: its rows stay spread over the input partitions and add
    to that site's sums, so a site holding a third of the cohort costs what its rows cost.
    """
    rows = flag_columns(_site_folds(df, outer, inner, seed, position), outer, inner).persist()
    try:
        names = training_sets(outer, inner)
        tried = [Problem(c, names.index((o, i)), epsilon) for o in range(outer) for c in grid for i in range(inner)]
        models = fit_problems(rows, tried, group="site", **options)
        sites = list(models)
        scores = {}
        # one scoring pass over all sites
        flat, which = [m for s in sites for m in models[s]], [q.rows for q in tried]
        errors, counts = group_errors(rows, flat, which, sites)
        for j, s in enumerate(sites):
            e, n = errors[j], counts[j]
            scores[s] = (e.reshape(-1, inner).sum(1) / np.maximum(n.reshape(-1, inner).sum(1), 1)).reshape(outer, -1)
        chosen = [[Problem(grid[int(scores[s][o].argmin())], o, epsilon) for o in range(outer)] for s in sites]
        final = fit_problems(rows, chosen, group="site", **options)
        table = {f"{s}:{o}": final[s][o] for s in sites for o in range(outer)}
        keyed = rows.select(
            "subject_id", "site", "age", "fold", "x", F.concat_ws(":", "site", "fold").alias("model")
        )
        out = predict_by(keyed, table, "model").drop("x", "model")
    finally:
        rows.unpersist()
    return out


def group_errors(
    rows: DataFrame, models: list, which: list[int], levels: list, group: str = "site"
) -> tuple[np.ndarray, np.ndarray]:
    """Held-out absolute error sums and counts per (group, problem); ``models`` by group, ``which`` the held-out set of each problem."""
    weights = np.column_stack([c for _, c in models])
    intercepts = np.array([b for b, _ in models])
    flags_of, each = np.asarray(which), len(which)
    shared = rows.sparkSession.sparkContext.broadcast((weights, intercepts))
    value_set = pa.array(levels)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercepts = shared.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y, held = matrix(batch, "x"), vector(batch, "age"), matrix(batch, "held")
            of = codes(batch.column("g"), value_set)
            for g in np.unique(of[of >= 0]):
                mine, columns = of == g, slice(g * each, (g + 1) * each)
                use = held[mine][:, flags_of]
                error = np.abs(y[mine][:, None] - x[mine] @ weights[:, columns] - intercepts[columns])
                part = np.array([(error * use).sum(0), use.sum(0)])
                sums[g] = sums[g] + part if g in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), list_array(np.stack([s.ravel() for s in sums.values()]))], ["g", "s"])

    picked = rows.select("x", "age", F.col("held").cast("array<double>").alias("held"), F.col(group).alias("g"))
    both = np.zeros((len(levels), 2, each))
    for r in sum_arrays(picked.mapInArrow(partial, "g int, s array<double>"), "s", ["g"]).collect():
        both[r["g"]] = np.asarray(r["s"]).reshape(2, each)
    shared.destroy()
    return both[:, 0], both[:, 1]


def weighted_classifier(
    df: DataFrame, c: float = 1.0, k: int = 5, seed: int = 42, balanced: bool = True, **options
) -> DataFrame:
    """Out-of-fold integer ages from one-vs-one separators with balanced class weights.

    (subject_id, age, label, fold, predicted). Weights are taken from the training rows.
    """
    rows = kfold_shuffled(df.withColumn("label", F.col("age").cast("int")), "subject_id", k, seed).persist()
    out = None
    try:
        for f in range(k):
            train, held = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
            weights = {r["label"]: r["weight"] for r in class_weights(train).collect()}
            model = fit_one_vs_one(train, sorted(weights), c, weights if balanced else None, **options)
            scored = vote(held.select("subject_id", "age", "label", "fold", "x"), model).drop("x")
            out = scored if out is None else out.unionByName(scored)
    finally:
        rows.unpersist()
    return out


def classifier_grid(df: DataFrame, grid: list[float] = C_GRID, k: int = 5, **options) -> list[dict]:
    """Balanced accuracy of each C."""
    scores = []
    for c in grid:
        row = balanced_accuracy(weighted_classifier(df, c, k, **options)).first()
        scores.append({"c": c, "balanced_accuracy": row["balanced_accuracy"]})
    return scores
