"""Scoring a list of candidate pipelines and reporting the best trade-offs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as prep
from ..operators import linear, trees
from ..operators.folds import kfold_shuffled, train_test_split
from ..operators.moments import collect_moments, total
from ..operators.scoring import absolute_errors
from ..operators.search import pareto_front
from .experiments import Pipeline, mask_step, pca_step

SCHEMA = "generation int, candidate string, complexity int, score double, error string"


@dataclass(frozen=True)
class Candidate:
    """A named pipeline: linear ones are fitted from moments, others by a train -> model function."""

    name: str
    complexity: int
    linear: Pipeline | None = None
    fit: Callable[[DataFrame], object] | None = None


def default_candidates() -> list[Candidate]:
    def ridge(alpha: float) -> Pipeline:
        return Pipeline(lambda m: linear.ridge(m, alpha))

    best_tenth = mask_step(lambda m: prep.percentile_mask(m, 10))
    varying = mask_step(lambda m: prep.variance_mask(m, 1e-4))
    return [
        Candidate("least_squares", 1, Pipeline(linear.ols)),
        *[Candidate(f"ridge_{a:g}", 1, ridge(a)) for a in (1.0, 10.0, 100.0)],
        Candidate("linear_process", 1, Pipeline(lambda m: linear.gpr_linear(m, 0.1, 1.0))),
        Candidate("axes_2+least_squares", 2, Pipeline(linear.ols, [pca_step(2)])),
        Candidate("axes_95%+ridge_1", 2, Pipeline(lambda m: linear.ridge(m, 1.0), [pca_step(0.95)])),
        Candidate("best_10%+least_squares", 2, Pipeline(linear.ols, [best_tenth])),
        Candidate("varying+best_10%+ridge_1", 3, Pipeline(lambda m: linear.ridge(m, 1.0), [varying, best_tenth])),
        Candidate("tree_3", 1, fit=lambda train: trees.decision_tree(train, 3, 5)),
    ]


def leaderboard(
    df: DataFrame, candidates: list[Candidate], k: int = 5, seed: int = 42, generation: int = 0
) -> DataFrame:
    """(generation, candidate, complexity, score, error): mean negative MAE over folds.

    Folds without a finite error are skipped; a candidate that fails scores -inf and
    carries its error. All linear candidates share one fitting and one scoring scan.
    """
    rows = kfold_shuffled(df, "subject_id", k, seed)
    rows = rows.withColumn("held", F.array(*[(F.col("fold") == f).cast("tinyint") for f in range(k)])).persist()
    out: dict[str, tuple[float, str | None]] = {}
    try:
        parts = collect_moments(rows, ["fold"])
        everything = total(parts)
        models, which, owner = [], [], []
        for c in candidates:
            try:
                if c.linear is not None:
                    fitted = [c.linear(everything.minus(parts[(f,)])) for f in range(k)]
                    models += fitted
                    which += list(range(k))
                    owner += [c.name] * k
                else:
                    out[c.name] = (_score_by_fold(rows, c, k), None)
            except (ValueError, np.linalg.LinAlgError) as e:  # a failing candidate is a result, not the end of the search
                out[c.name] = (float("-inf"), f"{type(e).__name__}: {e}"[:200])
        if models:
            errors, counts = absolute_errors(rows, models, which)
            mae = np.where(counts > 0, errors / np.maximum(counts, 1), np.nan)
            for name in dict.fromkeys(owner):
                mine = mae[[o == name for o in owner]]
                out[name] = (float(-np.nanmean(mine)), None)
    finally:
        rows.unpersist()
    table = [(generation, c.name, c.complexity, *out[c.name]) for c in candidates]
    return df.sparkSession.createDataFrame(table, SCHEMA)


def _score_by_fold(rows: DataFrame, candidate: Candidate, k: int) -> float:
    scores = []
    for f in range(k):
        model = candidate.fit(rows.where(F.col("fold") != f))
        scored = trees.predict(model, rows.where(F.col("fold") == f))
        scores.append(scored.agg(F.avg(F.abs(F.col("age") - F.col("prediction")))).first()[0])
    finite = [s for s in scores if s is not None and np.isfinite(s)]
    return -float(np.mean(finite))


def holdout_leaderboard(
    df: DataFrame, candidates: list[Candidate], test_size: float = 0.25, seed: int = 20, k: int = 5
) -> DataFrame:
    """Front members refitted on the training part, with their hold-out MAE."""
    rows = train_test_split(df, "subject_id", test_size, seed).persist()
    try:
        train, test = rows.where("NOT is_test"), rows.where("is_test")
        board = leaderboard(train.drop("is_test"), candidates, k).select("candidate", "complexity", "score")
        members = {r["candidate"]: r for r in pareto_front(board).collect()}
        chosen = [c for c in candidates if c.name in members]
        lines = [c for c in chosen if c.linear is not None]
        maes: dict[str, float] = {}
        if lines:
            m = total(collect_moments(train))
            flagged = test.withColumn("held", F.array(F.lit(1)))
            errors, counts = absolute_errors(flagged, [c.linear(m) for c in lines], [0] * len(lines))
            maes.update({c.name: float(e / n) for c, e, n in zip(lines, errors, counts)})
        for c in chosen:
            if c.fit is not None:
                scored = trees.predict(c.fit(train), test)
                maes[c.name] = scored.agg(F.avg(F.abs(F.col("age") - F.col("prediction")))).first()[0]
    finally:
        rows.unpersist()
    table = [(c.name, c.complexity, float(members[c.name]["score"]), maes[c.name]) for c in chosen]
    return df.sparkSession.createDataFrame(table, "candidate string, complexity int, score double, test_mae double")
