"""The learners, wired to the library's column names."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import DataFrame, SparkSession

from propensity.plans.features import BINNED_FEATURES, FEATURES, learner_of
from propensity.plans.forests import KeyedForest, SharedBoosting
from propensity.schema import LABEL, WEIGHT

SEED = 42
#: more than any feature has: then the learners look at 65,536 rows at least to find the bins, which no bin is rare enough to escape
MAX_BINS = 256


def logistic_regression(
    reg_param: float = 0.1,
    max_iter: int = 10,
    elastic_net: float = 0.0,
    features: str = FEATURES,
    weight: str | None = WEIGHT,
    tolerance: float = 1e-6,
) -> LogisticRegression:
    """Logistic regression; ``reg_param=0`` fits without regularization, ``weight=None`` without weights."""
    learner = LogisticRegression(
        featuresCol=features,
        labelCol=LABEL,
        regParam=reg_param,
        elasticNetParam=elastic_net,
        maxIter=max_iter,
        tol=tolerance,
    )
    return learner.setWeightCol(weight) if weight else learner


def random_forest(
    trees: int = 20,
    depth: int = 5,
    features: str = BINNED_FEATURES,
    weight: str | None = WEIGHT,
    seed: int = SEED,
    bootstrap: bool = True,
    columns_per_split: str = "auto",
) -> KeyedForest:
    """Random forest over binned features, its bootstrap drawn from row keys; without ``bootstrap`` every tree sees all rows once."""
    learner = KeyedForest(
        featuresCol=features,
        labelCol=LABEL,
        predictionCol="prediction",
        numTrees=trees,
        maxDepth=depth,
        maxBins=MAX_BINS,
        seed=seed,
        bootstrap=bootstrap,
        featureSubsetStrategy=columns_per_split,
    )
    return learner.setWeightCol(weight) if weight else learner


def gradient_boosted_trees(
    iterations: int = 20,
    depth: int = 3,
    features: str = BINNED_FEATURES,
    weight: str | None = WEIGHT,
    seed: int = SEED,
) -> GBTClassifier:
    """Gradient-boosted trees over binned features, with a fixed seed."""
    learner = SharedBoosting(
        featuresCol=features, labelCol=LABEL, maxIter=iterations, maxDepth=depth, maxBins=MAX_BINS, seed=seed
    )
    return learner.setWeightCol(weight) if weight else learner


def coefficient_table(spark: SparkSession, model: PipelineModel, names: list[str]) -> DataFrame:
    """Intercept and coefficients of a fitted logistic regression as rows ``(feature, coefficient)``.

    One row per feature: the size of the model, not of the data.
    """
    fitted = learner_of(model)
    rows = [("(intercept)", float(fitted.intercept))]
    rows += [(name, float(value)) for name, value in zip(names, fitted.coefficients.toArray())]
    return spark.createDataFrame(rows, "feature string, coefficient double")
