"""Studies: folds, preparation, fitting, out-of-fold prediction and parameter search.

Linear candidates are functions of second moments. One scan collects moments per fold
pattern; any training set is a sum of patterns, so the whole grid of a nested
cross-validation is fitted from that scan, and one more scan scores it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as prep
from ..operators.digits import column_quantiles
from ..operators.folds import fold_starts, kfold_contiguous, kfold_shuffled, literal
from ..operators.linear import Coefficients
from ..operators.moments import Moments, collect_moments, total
from ..operators.ranks import order_statistics
from ..operators.scoring import absolute_errors, predict_by, predict_column

Fit = Callable[[Moments], Coefficients]
Step = Callable[[Moments], prep.Affine]


@dataclass(frozen=True)
class Pipeline:
    """Linear preparation steps and a final fit, all on moments; coefficients come back in input units."""

    fit: Fit
    steps: list[Step] = field(default_factory=list)

    def __call__(self, m: Moments, scale: prep.Affine | None = None) -> Coefficients:
        steps = ([lambda _: scale] if scale else []) + self.steps
        weights, offset, current = np.eye(len(m.mean_x)), np.zeros_like(m.mean_x), m
        for step in steps:
            a = step(current)
            weights, offset = weights @ a.weights, (offset - a.center) @ a.weights
            current = current.project(a.weights, a.center)
        intercept, coef = self.fit(current)
        return intercept + float(offset @ coef), weights @ coef


def pca_step(components: float | int) -> Step:
    """Principal axes fitted on the training moments."""
    return lambda m: prep.fit_pca(m, components)[0]


def mask_step(choose: Callable[[Moments], np.ndarray]) -> Step:
    return lambda m: prep.Affine(np.zeros_like(m.mean_x), np.eye(len(m.mean_x))[:, choose(m)])


def training_scales(df: DataFrame, k: int, fold: str = "fold") -> dict[int, prep.Affine]:
    """Robust scaling of every training set (all folds but one), from the counts of its folds."""
    sets = [[g for g in range(k) if g != f] for f in range(k)]
    return {f: prep.robust_affine(q) for f, q in enumerate(column_quantiles(df, prep.QUARTILES, "x", fold, sets))}


def cross_validate(
    df: DataFrame, fit: Pipeline, k: int = 5, seed: int = 42, scale: bool = False, folded: bool = False
) -> DataFrame:
    """Out-of-fold prediction of every subject: (subject_id, age, fold, prediction).

    ``folded`` takes an existing ``fold`` column instead of assigning one.
    """
    rows = df if folded else kfold_shuffled(df, "subject_id", k, seed)
    parts = collect_moments(rows, ["fold"])
    everything = total(parts)
    scales = training_scales(rows, k) if scale else {}
    models = {key[0]: fit(everything.minus(part), scales.get(key[0])) for key, part in parts.items()}
    return predict_by(rows.select("subject_id", "age", "fold", "x"), models, "fold").drop("x")


def fold_errors(predictions: DataFrame) -> DataFrame:
    from ..operators.stats import mae_per_fold

    return mae_per_fold(predictions)


def refit_full(df: DataFrame, fit: Pipeline, scale: bool = False) -> Coefficients:
    return fit(total(collect_moments(df)), prep.collect_robust(df) if scale else None)


def fit_predict_holdout(train: DataFrame, test: DataFrame, fit: Pipeline, scale: bool = False) -> DataFrame:
    """Fit on one table, predict another: (subject_id, prediction)."""
    return test.select("subject_id", predict_column(*refit_full(train, fit, scale)).alias("prediction"))


# ---------------------------------------------------------------- nested folds


def nested_folds(df: DataFrame, position: str = "position", outer: int = 5, inner: int = 5, seed: int = 42) -> DataFrame:
    """``fold``, and ``inner``: for each outer fold the row's inner fold, -1 where it is held out.

    Inner folds are contiguous in ``position`` among the outer training rows. Their cuts
    (outer x (inner - 1) numbers) are exact order statistics, so rows are only compared.
    """
    rows = kfold_shuffled(df, "subject_id", outer, seed)
    training = rows.select(position, "subject_id", "fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("o"))
    exact = F.struct(F.col(position).alias("p"), F.col("subject_id").alias("i"))
    training = training.where(F.col("o") != F.col("fold")).withColumn("_exact", exact)
    cuts = order_statistics(training, position, lambda n: fold_starts(n, inner), ["o"], tie="_exact")
    by_outer: dict[int, list[tuple]] = {o: [] for o in range(outer)}
    for r in cuts.collect():
        by_outer[r["o"]].append((r["value"], r["tie"]))
    inner_folds = []
    kind = training.schema["_exact"].dataType
    # positions that fall together as doubles are told apart by their own value, equal ones by id
    me = F.struct(F.col(position).cast("double").alias("value"), exact.alias("tie"))
    for o in range(outer):
        cut = [F.struct(F.lit(v).alias("value"), literal(t, kind).alias("tie")) for v, t in sorted(by_outer[o])]
        passed = sum((F.when(me >= c, 1).otherwise(0) for c in cut), F.lit(0))
        inner_folds.append(F.when(F.col("fold") == o, F.lit(-1)).otherwise(passed))
    return rows.withColumn("inner", F.array(*inner_folds))


def training_sets(outer: int, inner: int) -> list[tuple[int, int | None]]:
    """Outer training sets first, then (outer, inner) ones."""
    return [(o, None) for o in range(outer)] + [(o, i) for o in range(outer) for i in range(inner)]


def flag_columns(df: DataFrame, outer: int, inner: int) -> DataFrame:
    """0/1 arrays ``train`` and ``held`` over ``training_sets``."""
    train, held = [], []
    for o, i in training_sets(outer, inner):
        mine = F.col("inner")[o]
        train.append((mine >= 0) if i is None else ((mine >= 0) & (mine != i)))
        held.append((mine < 0) if i is None else (mine == i))
    return df.withColumn("train", F.array(*[c.cast("tinyint") for c in train])).withColumn(
        "held", F.array(*[c.cast("tinyint") for c in held])
    )


def set_moments(parts: dict[tuple, Moments], outer: int, inner: int) -> list[Moments]:
    """Moments of every training set as sums over fold patterns."""
    out = []
    for o, i in training_sets(outer, inner):
        chosen = {k: m for k, m in parts.items() if _in_training(k[0], o, i)}
        out.append(total(chosen))
    return out


def _in_training(pattern: str, o: int, i: int | None) -> bool:
    mine = int(pattern.split(",")[o])
    return mine >= 0 and mine != i


def weighted_scores(errors: np.ndarray, counts: np.ndarray, inner: int) -> np.ndarray:
    """Mean absolute error over inner folds weighted by fold size: sums of errors over sums of rows."""
    return errors.reshape(-1, inner).sum(1) / counts.reshape(-1, inner).sum(1)


def nested_cv(
    df: DataFrame, params: list, build: Callable[[object], Pipeline], outer: int = 5, inner: int = 5, seed: int = 42
) -> tuple[DataFrame, list[dict]]:
    """Parameter search inside each outer training set: (predictions, chosen parameter per fold).

    Two scans in all: moments per fold pattern, then the held-out errors of every
    (outer, inner, parameter).
    """
    rows = flag_columns(nested_folds(df, outer=outer, inner=inner, seed=seed), outer, inner)
    keyed = rows.withColumn("pattern", F.concat_ws(",", F.transform("inner", lambda v: v.cast("string"))))
    sets = set_moments(collect_moments(keyed, ["pattern"]), outer, inner)
    pipelines = [build(p) for p in params]
    names = training_sets(outer, inner)
    models, which = [], []
    for o in range(outer):
        for pipeline in pipelines:
            for i in range(inner):
                s = names.index((o, i))
                models.append(pipeline(sets[s]))
                which.append(s)
    errors, counts = absolute_errors(rows, models, which)
    scores = weighted_scores(errors, counts, inner).reshape(outer, len(params))
    chosen, final = [], {}
    for o in range(outer):
        best = int(np.argmin(scores[o]))
        chosen.append({"fold": o, "param": params[best], "mae": float(scores[o][best])})
        final[o] = pipelines[best](sets[o])
    return predict_by(rows.select("subject_id", "age", "fold", "x"), final, "fold").drop("x"), chosen


def grid_search(
    df: DataFrame, params: list, build: Callable[[object], Pipeline], k: int = 5, position: str = "position"
) -> list[dict]:
    """Fold-size weighted MAE of each parameter over k contiguous folds, in parameter order."""
    rows = kfold_contiguous(df, position, "subject_id", k)
    rows = rows.withColumn("held", F.array(*[(F.col("fold") == f).cast("tinyint") for f in range(k)]))
    parts = collect_moments(rows, ["fold"])
    everything = total(parts)
    models = [build(p)(everything.minus(parts[(f,)])) for p in params for f in range(k)]
    errors, counts = absolute_errors(rows, models, [f for _ in params for f in range(k)])
    scores = weighted_scores(errors, counts, k)
    return [{"param_pos": i, "param": p, "mae": float(s)} for i, (p, s) in enumerate(zip(params, scores))]


def best_of(scores: list[dict]) -> dict:
    """Smallest MAE, first of ties."""
    return min(scores, key=lambda s: (s["mae"], s["param_pos"]))
