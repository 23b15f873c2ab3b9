"""The query registry and the shared views, once for Spark and once as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_VIEWS = {
    "cohort": """
        SELECT 'sub' || c_custkey AS subject_id, 20 + (c_custkey * 37) % 61 + c_acctbal / 10000 AS age,
               CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'm' END AS gender, c_nationkey AS site
        FROM customer WHERE c_custkey % 3 <> 0""",
    "features": """
        SELECT 'sub' || vec_id AS subject_id, vec_id AS position, label AS site,
               CAST(embedding AS DOUBLE[]) AS x,
               50 + 40 * CAST(embedding[1] AS DOUBLE) - 25 * CAST(embedding[2] AS DOUBLE)
                  + 10 * CAST(embedding[3] AS DOUBLE) + label AS age
        FROM embeddings""",
    "subjects": """
        SELECT o_orderkey AS subject_id, c_nationkey AS site, 20 + o_totalprice / 10000 AS age,
               o_orderkey % 2 = 0 AS is_train
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "predictions": """
        SELECT s.subject_id, s.site, s.age, s.is_train, 'm' || l_linenumber AS model,
               s.age + (l_quantity - 25.5) * 0.1 * (1 + l_linenumber) AS prediction
        FROM lineitem JOIN subjects s ON l_orderkey = s.subject_id""",
    "model_errors": """
        SELECT model, avg(abs(age - prediction)) AS mae FROM predictions WHERE is_train GROUP BY model""",
    "sites": "SELECT CAST(range AS INTEGER) AS site FROM range(26)",
    "site_ranges": """
        SELECT sites.site, min(s.age) AS min_age, max(s.age) AS max_age
        FROM sites LEFT JOIN (SELECT * FROM subjects WHERE is_train) s ON s.site = sites.site GROUP BY sites.site""",
    "candidates": """
        SELECT CAST(p_partkey % 5 AS INTEGER) AS generation, p_partkey AS candidate, p_size AS complexity,
               CASE WHEN p_partkey % 17 = 0 THEN CAST('-infinity' AS DOUBLE) ELSE -p_retailprice / 100 END AS score
        FROM part""",
    "one_each": """
        SELECT subject_id, model, min(prediction) AS prediction FROM predictions
        WHERE NOT is_train GROUP BY subject_id, model HAVING count(*) = 1""",
}
SQL_NEEDS = {
    "predictions": ["subjects"],
    "model_errors": ["predictions"],
    "site_ranges": ["sites", "subjects"],
    "one_each": ["predictions"],
}


def with_views(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the WITH clause of the named views and whatever they need."""
    ordered: list[str] = []

    def add(view: str) -> None:
        for need in SQL_NEEDS.get(view, []):
            add(need)
        if view not in ordered:
            ordered.append(view)

    for view in views:
        add(view)
    clauses = [f"{v} AS ({SQL_VIEWS[v]})" for v in ordered]
    clauses += [f"{name} AS ({sql})" for name, sql in (extra or {}).items()]
    return ("WITH " + ",\n".join(clauses) + "\n" if clauses else "") + body


def query(name: str, body: str | None = None, *views: str, extra: dict[str, str] | None = None):
    """Register a Spark query and, if SQL can say it, its twin."""

    def register(fn):
        QUERIES[name] = fn
        if body is not None:
            ORACLES[name] = with_views(body, *views, extra=extra)
        return fn

    return register
