"""Joins on subject keys and lookups of small per-model and per-site tables.

No join here carries a broadcast hint: Spark broadcasts a side only when its measured
size is below ``spark.sql.autoBroadcastJoinThreshold`` and splits skewed sort-merge
partitions otherwise. Lookup tables derived by aggregation are settled first, which gives
them a measured size, so that predictions are never shuffled by model or site.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle


def join_tables(tables: list[DataFrame], key: str) -> DataFrame:
    """Inner equi-join chain; every table is shuffled once, on the same key."""
    return reduce(lambda left, right: left.join(right, key), tables)


def join_named_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.join(right, left[left_key] == right[right_key]).drop(right[right_key])


def join_demographics_right(demographics: DataFrame, imaged: DataFrame, key: str = "subject_id") -> DataFrame:
    """Keep every imaged subject; demographics are NULL where unknown."""
    return demographics.join(imaged, key, "right")


def filter_site(df: DataFrame, site: int, column: str = "site") -> DataFrame:
    """Rows of one site; -1 keeps all sites."""
    return df if site < 0 else df.where(F.col(column) == site)


def filter_in_ids(df: DataFrame, ids: DataFrame, key: str = "subject_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def reindex_to_list(df: DataFrame, ids: DataFrame, key: str = "subject_id", position: str = "position") -> DataFrame:
    """Rows in the order of the id table, NULL for ids without a row."""
    return ids.join(df, key, "left").orderBy(position)


def missing_ids(df: DataFrame, wanted: DataFrame, key: str = "subject_id") -> DataFrame:
    return wanted.select(key).join(df.select(key), key, "left_anti")


def require_ids(df: DataFrame, wanted: DataFrame, key: str = "subject_id") -> DataFrame:
    """``df`` restricted to the wanted ids; raises when one of them is absent."""
    first = missing_ids(df, wanted, key).limit(1).collect()
    if first:
        raise KeyError(f"no row for {key}={first[0][key]!r}")
    return filter_in_ids(df, wanted, key)


def exactly_one_match(
    predictions: DataFrame, keys: tuple[str, ...] = ("subject_id", "model"), values: tuple[str, ...] = ("prediction",)
) -> DataFrame:
    """Rows whose key occurs exactly once.

    Counted with a combining aggregate instead of a window, so a key repeated very
    often collapses before the shuffle.
    """
    counted = predictions.groupBy(*keys).agg(
        F.count("*").alias("_rows"), *[F.any_value(v).alias(v) for v in values]
    )
    return counted.where("_rows = 1").drop("_rows")


def first_error_per_model(errors: DataFrame, order: Column | None = None) -> DataFrame:
    """One MAE per model: the first by ``order``, or the smallest when there is no order."""
    mae = F.min_by("mae", order) if order is not None else F.min("mae")
    return errors.groupBy("model").agg(mae.alias("mae"))


def lookup_model_error(predictions: DataFrame, errors: DataFrame) -> DataFrame:
    """The MAE of each prediction's model, NULL for a model that has none."""
    return predictions.join(settle(first_error_per_model(errors)), "model", "left")


def require_model_errors(predictions: DataFrame, errors: DataFrame) -> None:
    """Raises when a model has predictions but no MAE."""
    unknown = predictions.select("model").distinct().join(errors.select("model"), "model", "left_anti")
    names = [r["model"] for r in unknown.limit(5).collect()]
    if names:
        raise KeyError(f"no MAE for the models {names}")


def lookup_site_range(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    return rows.join(settle(ranges.select("site", "min_age", "max_age")), "site", "left")


def common_subjects(errors: DataFrame, models: list[str], value: str = "error") -> DataFrame:
    """One row per subject that every model predicted, one column per model.

    Replaces a chain of inner joins by a single combining aggregate; several rows of one
    model are averaged.
    """
    wide = errors.groupBy("subject_id").pivot("model", models).agg(F.avg(value))
    return wide.dropna(subset=models)


def pair_modalities(first: DataFrame, second: DataFrame, key: str = "subject_id") -> DataFrame:
    """Both modalities of a subject, matched by id: columns ``x_first`` and ``x_second``."""
    return first.select(key, F.col("x").alias("x_first")).join(second.select(key, F.col("x").alias("x_second")), key)


def stack_by_name(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)
