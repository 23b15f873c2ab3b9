"""Fold and split assignment as map-side comparisons with a few exact boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .ranks import attach, order_statistics


def shuffle_key(id_: Column, seed: int | str) -> Column:
    """Seeded pseudo-random order of ids: the first 13 hex digits of an md5, exact in a double."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")


def fold_starts(n: Column, k: int) -> Column:
    """First position of folds 1..k-1; the first n mod k folds are one row longer."""
    size, longer = F.floor(n / k), n % k
    return F.array(*[(F.lit(j) * size + F.least(F.lit(j), longer)).cast("bigint") for j in range(1, k)])


def literal(value, kind: DataType) -> Column:
    """A driver value, also a row of values, as a constant of type ``kind``."""
    if isinstance(kind, StructType) and value is not None:
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


def _assign(
    df: DataFrame, key: Column, id_col: str, starts, by: list[str], out: str, **options
) -> DataFrame:
    keyed = df.withColumn("_key", key)
    cuts = order_statistics(keyed, "_key", starts, by, tie=id_col, **options)
    me = F.struct(F.col("_key").alias("value"), F.col(id_col).alias("tie"))
    if not by:
        # k - 1 literals, evaluated once; assigning folds is then a projection
        kind = df.schema[id_col].dataType
        passed = F.lit(0)
        for cut in cuts.collect():
            start = F.struct(F.lit(cut["value"]).alias("value"), literal(cut["tie"], kind).alias("tie"))
            passed = passed + F.when(start <= me, 1).otherwise(0)
        return keyed.withColumn(out, passed).drop("_key")
    # a group smaller than two rows has no cut
    cuts = cuts.groupBy(*by).agg(F.collect_list(F.struct("value", "tie")).alias("cuts"))
    placed = attach(keyed, cuts, by, "cuts", "left")
    passed = F.size(F.filter(F.coalesce("cuts", F.array().cast(cuts.schema["cuts"].dataType)), lambda c: c <= me))
    return placed.withColumn(out, passed.cast("int")).drop("_key", "cuts")


def kfold_contiguous(
    df: DataFrame, position: str, id_col: str, k: int = 5, by: list[str] | None = None, out: str = "fold", **options
) -> DataFrame:
    """k contiguous blocks in ``position`` order.

    Cuts are found by the position as a double; positions that fall together there are told apart by their own
    value and then by id.
    """
    exact = df.withColumn("_exact", F.struct(F.col(position).alias("p"), F.col(id_col).alias("i")))
    placed = _assign(exact, F.col(position).cast("double"), "_exact", lambda n: fold_starts(n, k), by or [], out, **options)
    return placed.drop("_exact")


def kfold_shuffled(
    df: DataFrame, id_col: str, k: int = 5, seed: int = 42, by: list[str] | None = None, out: str = "fold", **options
) -> DataFrame:
    """Seeded random folds of the same sizes; ``by`` restarts the folds inside each group.

    Copies of one id always share a fold.
    """
    return _assign(df, shuffle_key(F.col(id_col), seed), id_col, lambda n: fold_starts(n, k), by or [], out, **options)


def train_test_split(
    df: DataFrame, id_col: str, test_size: float = 0.25, seed: int = 20, out: str = "is_test", **options
) -> DataFrame:
    """Mark ceil(test_size * n) seeded random rows as the hold-out."""
    split = _assign(
        df,
        shuffle_key(F.col(id_col), seed),
        id_col,
        lambda n: F.array(F.ceil(n * test_size).cast("bigint")),
        [],
        "_side",
        **options,
    )
    return split.withColumn(out, F.col("_side") == 0).drop("_side")


def distinct_sites(df: DataFrame, site: str = "site") -> DataFrame:
    return df.select(site).distinct().orderBy(site)
