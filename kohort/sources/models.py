"""Fitted models on disk, to be scored by a later job."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import RobustScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession

from ..operators.linear import Coefficients
from ..operators.scoring import predict_column


def save_coefficients(spark: SparkSession, model: Coefficients, path: str) -> None:
    """A linear model, preparation folded in, as a one-row table."""
    row = [(float(model[0]), [float(c) for c in model[1]])]
    spark.createDataFrame(row, "intercept double, coef array<double>").write.mode("overwrite").parquet(path)


def load_coefficients(spark: SparkSession, path: str) -> Coefficients:
    row = spark.read.parquet(path).first()
    return row["intercept"], np.array(row["coef"])


def score_saved_model(df: DataFrame, path: str) -> DataFrame:
    """Predictions of a saved linear model for a new cohort."""
    model = load_coefficients(df.sparkSession, path)
    return df.select("subject_id", predict_column(*model).alias("prediction"))


def fit_pipeline(train: DataFrame, y: str = "age") -> PipelineModel:
    """Scaler and least squares as one MLlib pipeline (the scaler's quantiles are approximate)."""
    stages = [
        RobustScaler(inputCol="_features", outputCol="_scaled", withCentering=True, relativeError=1e-4),
        LinearRegression(featuresCol="_scaled", labelCol=y, predictionCol="prediction", solver="normal"),
    ]
    return Pipeline(stages=stages).fit(train.withColumn("_features", array_to_vector("x")))


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def score_pipeline(df: DataFrame, path: str) -> DataFrame:
    scored = PipelineModel.load(path).transform(df.withColumn("_features", array_to_vector("x")))
    return scored.select("subject_id", "prediction")
