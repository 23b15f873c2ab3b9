"""Tree regressors from MLlib on array features (splits are taken from binned columns)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame


def with_vector(df: DataFrame, x: str = "x") -> DataFrame:
    return df.withColumn("_features", array_to_vector(x))


def decision_tree(train: DataFrame, max_depth: int = 5, min_leaf: int = 1, y: str = "age"):
    tree = DecisionTreeRegressor(
        featuresCol="_features", labelCol=y, maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=42
    )
    return tree.fit(with_vector(train))


def random_forest(
    train: DataFrame,
    trees: int = 100,
    max_features: float = 0.45,
    min_leaf: int = 15,
    bootstrap: bool = False,
    max_depth: int = 10,
    seed: int = 42,
    y: str = "age",
):
    forest = RandomForestRegressor(
        featuresCol="_features",
        labelCol=y,
        numTrees=trees,
        featureSubsetStrategy=str(max_features),
        minInstancesPerNode=min_leaf,
        bootstrap=bootstrap,
        maxDepth=max_depth,
        seed=seed,
    )
    return forest.fit(with_vector(train))


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(with_vector(df)).drop("_features")
