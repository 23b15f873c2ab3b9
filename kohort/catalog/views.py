"""Deterministic study tables over the test parquet files (the Spark side of the SQL views)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MODELS = [f"m{i}" for i in range(1, 8)]
REGION_TABLES = 9
REGION_WIDTH = 7


SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; its schema is looked up once, later reads state it and start no footer job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(key % 3 != 0).select(
        F.concat(F.lit("sub"), key).alias("subject_id"),
        (20 + (key * 37) % 61 + F.col("c_acctbal") / 10000).alias("age"),
        F.when(key % 2 == 0, "f").otherwise("m").alias("gender"),
        F.col("c_nationkey").alias("site"),
    )


def region_column(k: int, i: int) -> str:
    return f"r{k}_{i}"


def region_table(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Table k of 9: key with suffix, seven measures; each table lacks other subjects."""
    e = F.col("embedding")
    measures = [
        e[REGION_WIDTH * (k - 1) + i].cast("double").alias(region_column(k, i)) for i in range(REGION_WIDTH)
    ]
    return (
        table(spark, sf_dir, "embeddings")
        .where(F.col("vec_id") % 50 != k)
        .select(F.concat(F.lit("sub"), "vec_id", F.lit("_raw/")).alias("key"), *measures)
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("sub"), "vec_id").alias("subject_id"),
        F.col("vec_id").alias("position"),
        F.col("label").alias("site"),
        e.cast("array<double>").alias("x"),
        (50 + 40 * e[0].cast("double") - 25 * e[1].cast("double") + 10 * e[2].cast("double") + F.col("label")).alias(
            "age"
        ),
    )


def features_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second modality of the same subjects."""
    return features(spark, sf_dir).withColumn("x", F.reverse("x"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 x 4 grids with some NaN and infinite voxels."""

    def spoil(value: Column, p: Column) -> Column:
        at = F.col("vec_id") + p
        return (
            F.when(at % 97 == 0, F.lit(float("nan")))
            .when(at % 101 == 0, F.lit(float("inf")))
            .otherwise(value.cast("double"))
        )

    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("sub"), "vec_id").alias("subject_id"), F.transform("embedding", spoil).alias("x")
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("subject_id"),
        F.col("c_nationkey").alias("site"),
        (20 + F.col("o_totalprice") / 10000).alias("age"),
        (F.col("o_orderkey") % 2 == 0).alias("is_train"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    people = subjects(spark, sf_dir)
    return lines.join(people, lines.l_orderkey == people.subject_id).select(
        "subject_id",
        "site",
        "age",
        "is_train",
        F.concat(F.lit("m"), "l_linenumber").alias("model"),
        (F.col("age") + (F.col("l_quantity") - 25.5) * 0.1 * (1 + F.col("l_linenumber"))).alias("prediction"),
    )


def train_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where("is_train")


def test_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where("NOT is_train")


def model_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        train_predictions(spark, sf_dir)
        .groupBy("model")
        .agg(F.avg(F.abs(F.col("age") - F.col("prediction"))).alias("mae"))
    )


def sites(spark: SparkSession) -> DataFrame:
    """The fixed list of sites, one of them without subjects."""
    return spark.range(26).select(F.col("id").cast("int").alias("site"))


def site_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stats import site_age_range

    return site_age_range(subjects(spark, sf_dir).where("is_train"), sites(spark))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (key % 5).cast("int").alias("generation"),
        key.alias("candidate"),
        F.col("p_size").alias("complexity"),
        F.when(key % 17 == 0, F.lit(float("-inf"))).otherwise(-F.col("p_retailprice") / 100).alias("score"),
    )


def r6(column: Column | str, name: str) -> Column:
    """Six decimals: engines differ in the last digits of sums."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name)


def r6_many(column: str, name: str) -> Column:
    """As ``r6``, the same number bit by bit, for columns of very many values: only those near a tie are rounded in decimals."""
    scaled = F.col(column) * 1e6
    plain = (F.abs(column) < 1e6) & (F.abs(scaled - F.rint(scaled)) < 0.499)
    # no negative zero
    return F.when(plain, F.rint(scaled) / 1e6 + F.lit(0.0)).otherwise(F.round(column, 6)).alias(name)
