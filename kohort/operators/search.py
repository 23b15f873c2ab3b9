"""Tables of a candidate search: Pareto front, survivor selection, parameter choice."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

RELATIVE, ABSOLUTE = 1e-5, 1e-8


def dedupe_candidates(new: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    """Candidates that were not evaluated before; of equal ones the first by ``order``."""
    others = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_first"))
    return first.select(key, "_first.*").join(known.select(key), key, "left_anti")


def best_param(scores: DataFrame, n: str = "n") -> DataFrame:
    """Best parameter by fold-size weighted mean score, first of ties.

    ``scores(param, param_pos, score, n)`` holds one row per parameter and fold.
    """
    mean = (F.sum(F.col("score") * F.col(n)) / F.sum(n)).alias("score")
    return scores.groupBy("param", "param_pos").agg(mean).orderBy(F.desc("score"), "param_pos").limit(1)


def _levels(candidates: DataFrame) -> DataFrame:
    """Distinct (complexity, score) points with their number of candidates."""
    return candidates.groupBy("complexity", "score").agg(F.count("*").alias("c"))


def _frontier(points: DataFrame) -> DataFrame:
    """Points no other point beats on low complexity and high score.

    The best score per complexity is aggregated first; the running maximum then walks
    over one row per complexity, a count of pipeline steps.
    """
    best = points.groupBy("complexity").agg(F.max("score").alias("score"))
    simpler = Window.orderBy("complexity").rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_before", F.max("score").over(simpler))
    return best.where(F.col("_before").isNull() | (F.col("score") > F.col("_before"))).drop("_before")


def pareto_front(candidates: DataFrame) -> DataFrame:
    """Non-dominated candidates, one per near-equal point (the smallest candidate id).

    Neighbouring front points whose complexity and score agree within 1e-8 + 1e-5 |value|
    count as one; the simpler point stays.
    """
    valid = candidates.where(F.col("score") > F.lit(float("-inf")))
    front = _frontier(valid)
    step = Window.orderBy("complexity")

    def close(name: str):
        mine, previous = F.col(name), F.lag(name).over(step)
        return F.abs(mine - previous) <= ABSOLUTE + RELATIVE * F.abs(previous)

    front = front.withColumn("_same", F.coalesce(close("complexity") & close("score"), F.lit(False)))
    front = front.where("NOT _same").drop("_same")
    members = valid.join(front, ["complexity", "score"])
    return members.groupBy("complexity", "score").agg(F.min("candidate").alias("candidate"))


def nondominated_ranks(candidates: DataFrame, wanted: int) -> DataFrame:
    """(complexity, score, front) for as many whole fronts as hold ``wanted`` candidates.

    A point that is r-th best at its own complexity lies in front r or later, and ``wanted``
    candidates fill at most ``wanted`` fronts, so deeper points are set aside exactly, with
    a per-complexity rank limit that Spark applies before its shuffle.
    """
    best = Window.partitionBy("complexity").orderBy(F.desc("score"))
    left = _levels(candidates).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= wanted).drop("_r")
    fronts, found = [], 0
    for front in count():
        # one written table per round: the next round reads it instead of replaying this one
        peeled = left.join(_frontier(left).withColumn("front", F.lit(front)), ["complexity", "score"], "left")
        peeled = cut_lineage(peeled)
        members, left = peeled.where("front IS NOT NULL"), peeled.where("front IS NULL").drop("front")
        size = members.agg(F.sum("c")).first()[0]
        if not size:
            break
        fronts.append(members)
        found += size
        if found >= wanted:
            break
    if not fronts:
        return left.withColumn("front", F.lit(0)).limit(0)
    out = fronts[0]
    for members in fronts[1:]:
        out = out.unionByName(members)
    return out


def nsga2_select(candidates: DataFrame, mu: int = 100) -> DataFrame:
    """mu survivors by front, then crowding distance (boundary points first), then id."""
    ranked = nondominated_ranks(candidates.where(F.col("score") > F.lit(float("-inf"))), mu)
    spans = Window.partitionBy("front")
    line = spans.orderBy("complexity")

    def gap(name: str):
        span = F.max(name).over(spans) - F.min(name).over(spans)
        width = F.lead(name).over(line) - F.lag(name).over(line)
        return F.when(width.isNull(), F.lit(float("inf"))).when(span == 0, 0.0).otherwise(F.abs(width) / span)

    crowded = ranked.withColumn("crowding", gap("complexity") + gap("score"))
    members = candidates.join(crowded, ["complexity", "score"])
    return members.orderBy("front", F.desc("crowding"), "candidate").limit(mu).select(
        "candidate", "complexity", "score", "front", "crowding"
    )
