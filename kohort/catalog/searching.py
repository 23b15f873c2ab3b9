"""Reports of a candidate search."""

from pyspark.sql import functions as F

from ..operators import linear, search
from ..plans import leaderboard as boards
from ..plans.experiments import Pipeline, pca_step
from . import views as V
from .registry import query


@query(
    "pareto_front",
    """SELECT complexity, score, min(candidate) AS candidate FROM candidates c WHERE NOT isinf(score) AND NOT EXISTS (
         SELECT 1 FROM candidates o WHERE o.complexity <= c.complexity AND o.score >= c.score
         AND (o.complexity < c.complexity OR o.score > c.score)) GROUP BY complexity, score""",
    "candidates",
)
def pareto_front(spark, d):
    return search.pareto_front(V.candidates(spark, d))


# front number = longest chain of points each beaten by the next
SELECTION = """WITH RECURSIVE candidates AS (SELECT p_partkey AS candidate, p_size AS complexity,
    -p_retailprice / 100 AS score FROM part WHERE p_partkey % 17 <> 0),
  points AS (SELECT DISTINCT complexity, score FROM candidates),
  near AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY complexity ORDER BY score DESC) <= 100),
  chains AS (SELECT complexity, score, 0 AS depth FROM near UNION
    SELECT n.complexity, n.score, c.depth + 1 FROM chains c JOIN near n ON c.complexity <= n.complexity
    AND c.score >= n.score AND (c.complexity < n.complexity OR c.score > n.score) WHERE c.depth < 20),
  fronts AS (SELECT complexity, score, max(depth) AS front FROM chains GROUP BY complexity, score),
  crowds AS (SELECT *, lead(complexity) OVER w - lag(complexity) OVER w AS wide, lead(score) OVER w - lag(score) OVER w AS high,
    max(complexity) OVER f - min(complexity) OVER f AS all_wide, max(score) OVER f - min(score) OVER f AS all_high
    FROM fronts WINDOW f AS (PARTITION BY front), w AS (PARTITION BY front ORDER BY complexity)),
  crowded AS (SELECT complexity, score, front, CASE WHEN wide IS NULL THEN CAST('infinity' AS DOUBLE) ELSE
    CASE WHEN all_wide = 0 THEN 0 ELSE abs(wide) / all_wide END + CASE WHEN all_high = 0 THEN 0 ELSE abs(high) / all_high END
    END AS crowding FROM crowds)
SELECT candidate, complexity, score, CAST(front AS INTEGER) AS front, round(crowding, 6) AS crowding
FROM candidates JOIN crowded USING (complexity, score) ORDER BY front, crowding DESC, candidate LIMIT 100"""


@query("nsga2_select", SELECTION)
def nsga2_select(spark, d):
    return search.nsga2_select(V.candidates(spark, d), 100).withColumn("crowding", F.round("crowding", 6))


@query(
    "dedupe_candidates",
    """SELECT pipeline, min(candidate) AS candidate FROM pipelines WHERE generation = 4 AND pipeline NOT IN
       (SELECT pipeline FROM pipelines WHERE generation < 4 AND candidate % 40 = 1) GROUP BY pipeline""",
    "candidates",
    extra={"pipelines": "SELECT *, 'step' || complexity AS pipeline FROM candidates"},
)
def dedupe_candidates(spark, d):
    pipelines = V.candidates(spark, d).withColumn("pipeline", F.concat(F.lit("step"), "complexity"))
    known = pipelines.where("generation < 4 AND candidate % 40 = 1")
    fresh = pipelines.where("generation = 4").select("pipeline", "candidate")
    return search.dedupe_candidates(fresh, known, "pipeline", "candidate")


@query("leaderboard")
def leaderboard(spark, d):
    # one component too few: a candidate that cannot be fitted stays on the board with -inf
    broken = boards.Candidate("axes_0+least_squares", 2, Pipeline(linear.ols, [pca_step(0)]))
    return boards.leaderboard(V.features(spark, d), [*boards.default_candidates(), broken])


@query("holdout_leaderboard")
def holdout_leaderboard(spark, d):
    return boards.holdout_leaderboard(V.features(spark, d), boards.default_candidates())
