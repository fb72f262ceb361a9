"""Slide-level estimators on pooled vectors, from pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import task_metrics

MODELS = {
    "logistic_regression": ("classification", lambda seed: LogisticRegression()),
    "random_forest_classifier": ("classification", lambda seed: RandomForestClassifier(seed=seed)),
    "gradient_boosting_classifier": ("classification", lambda seed: GBTClassifier(seed=seed)),
    "linear_svc": ("classification", lambda seed: LinearSVC()),
    "linear_regression": ("regression", lambda seed: LinearRegression()),
    "ridge": ("regression", lambda seed: LinearRegression(regParam=1.0, elasticNetParam=0.0)),
    "elastic_net": ("regression", lambda seed: LinearRegression(regParam=0.1, elasticNetParam=0.5)),
    "glm": ("regression", lambda seed: GeneralizedLinearRegression()),
    "decision_tree_regressor": ("regression", lambda seed: DecisionTreeRegressor(seed=seed)),
    "random_forest_regressor": ("regression", lambda seed: RandomForestRegressor(seed=seed)),
    "gradient_boosting_regressor": ("regression", lambda seed: GBTRegressor(seed=seed)),
    "aft_survival": ("survival", lambda seed: AFTSurvivalRegression(censorCol="event")),
}


def mlp(layers: list[int], seed: int = 0) -> MultilayerPerceptronClassifier:
    """A classifier on mean-pooled bags; layers from input size to classes."""
    return MultilayerPerceptronClassifier(layers=layers, seed=seed)


def slide_vectors(pooled: DataFrame) -> DataFrame:
    """(sample_id, features) from (sample_id, dim, value)."""
    rows = pooled.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("v"))
    return rows.select("sample_id", array_to_vector("v").alias("features"))


def fit(name: str, train: DataFrame, normalize: bool = True, seed: int = 0):
    """A fitted pipeline of a named estimator; train: features and label (survival: time as label, and event)."""
    task, make = MODELS[name]
    scaler = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True)] if normalize else []
    estimator = make(seed).setFeaturesCol("scaled" if normalize else "features")
    return Pipeline(stages=[*scaler, estimator]).fit(train)


def evaluate(model, rows: DataFrame, task: str) -> DataFrame:
    """One row of the task's metrics of a fitted model."""
    out = model.transform(rows)
    if task == "classification":
        return task_metrics.classification(out.select(F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat")))
    if task == "regression":
        return task_metrics.regression(out.select(F.col("label").alias("y"), F.col("prediction").alias("yhat")))
    return task_metrics.concordance(out.select(F.col("label").alias("time"), F.col("event").cast("int").alias("event"), (-F.col("prediction")).alias("risk")))


def probabilities(model, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return out.select("sample_id", "label", vector_to_array("probability").alias("probs")) if "probability" in out.columns else out.select("sample_id", "label", "prediction")
