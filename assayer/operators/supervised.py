"""A-LR: a supervised ceiling for the unsupervised detectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from assayer.operators.features import FEATURES


@dataclass(frozen=True)
class LogisticModel:
    model: LogisticRegressionModel
    name = "logistic_regression"

    def score(self, df: DataFrame) -> DataFrame:
        vectors = df.withColumn("__v", array_to_vector(F.col(FEATURES).cast("array<double>")))
        return self.model.transform(vectors).withColumn(
            "score", vector_to_array("__p")[1]).drop("__v", "__p", "__raw", "__label")


def fit_logistic(df: DataFrame, label: str = "label", max_iter: int = 2000) -> LogisticModel:
    """Both classes weigh the same in total; the penalty equals an inverse strength of 1."""
    sizes = {r["y"]: r["n"] for r in df.groupBy(F.col(label).cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(sizes.values())
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    if not positive or not negative:
        raise ValueError("both classes are needed")
    weight = F.when(F.col("y") == 1, rows / (2 * positive)).otherwise(rows / (2 * negative))
    data = df.select(array_to_vector(F.col(FEATURES).cast("array<double>")).alias("__v"),
                     F.col(label).cast("double").alias("y")).withColumn("w", weight)
    fitted = LogisticRegression(
        featuresCol="__v", labelCol="y", weightCol="w", probabilityCol="__p", rawPredictionCol="__raw",
        predictionCol="__label", maxIter=max_iter, regParam=1.0 / rows, standardization=False).fit(data)
    return LogisticModel(fitted)
