"""Fitted models: saved and loaded as Spark pipelines, so any executor folder that Spark writes to will do."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_router(df: DataFrame, vector: str = "v", label: str = "label", iterations: int = 20, ridge: float = 0.1) -> PipelineModel:
    """A linear probe from vectors to scopes."""
    data = df.select(array_to_vector(vector).alias("x"), F.col(label).cast("double").alias("y"))
    return Pipeline(stages=[LogisticRegression(featuresCol="x", labelCol="y", maxIter=iterations, regParam=ridge)]).fit(data)


def route(model: PipelineModel, df: DataFrame, vector: str = "v", k: int = 1) -> DataFrame:
    """Adds ``scopes``: the k most probable labels with their probabilities, best first."""
    p = vector_to_array(F.col("probability"))
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("minus"), i.alias("scope")))
    top = F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s["scope"].alias("scope"), (-s["minus"]).alias("confidence")))
    scored = model.transform(df.withColumn("x", array_to_vector(vector)))
    return scored.withColumn("scopes", top).drop("x", "rawPrediction", "probability", "prediction")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
