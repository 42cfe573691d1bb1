"""From a cleaned frame to a fitted pipeline: label filter, split, class weights, stages."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.operators.cleaning import drop_null_labels
from propensity.operators.weighting import (
    NEGATIVE_WEIGHT,
    POSITIVE_WEIGHT,
    balanced_weights,
    with_class_weights,
)
from propensity.plans.features import BINNED_FEATURES, feature_stages
from propensity.plans.tuning import TrainingPipeline
from propensity.schema import LABEL, ROW_KEY
from propensity.session import scratch, small_splits
from propensity.sources.tables import stage, stage_split, stage_spread


class PreparedData(NamedTuple):
    train: DataFrame
    test: DataFrame


def prepare(
    df: DataFrame,
    key: str = ROW_KEY,
    train_percent: int = 80,
    weights: str = "constant",
    columns: list[str] | None = None,
) -> PreparedData:
    """Drop unlabelled rows, split by key into a staged table, and weight the training side only.

    ``weights`` is ``"constant"`` (0.2 / 0.8) or ``"balanced"`` (from the class counts of the training side).
    ``columns`` limits what is staged, next to key and label. Rows without a key are refused: all would fall on one side and
    into one fold.
    """
    if weights not in ("constant", "balanced"):
        raise ValueError(f"weights are 'constant' or 'balanced', got {weights!r}")
    columns = None if columns is None else [LABEL, *columns]
    train, test = stage_split(drop_null_labels(df, LABEL), key, train_percent, columns)
    keyless = train.filter(F.col(key).isNull()).count() + test.filter(F.col(key).isNull()).count()
    if keyless:
        raise ValueError(f"{keyless} rows have no {key!r}")
    positive, negative = (
        (POSITIVE_WEIGHT, NEGATIVE_WEIGHT) if weights == "constant" else balanced_weights(train, LABEL)
    )
    return PreparedData(with_class_weights(train, LABEL, positive, negative), test)


def training_pipeline(
    learner: Estimator, feature_set: str = "full", scale: bool = False, **feature_options
) -> TrainingPipeline:
    """Feature stages and learner as one estimator, so that no statistic sees rows outside its training set.

    Options are those of ``feature_stages``; with ``out_of_fold=3`` fits, searches and comparisons train on out-of-fold encodings.
    """
    binned = learner.getFeaturesCol() == BINNED_FEATURES
    return TrainingPipeline(stages=[*feature_stages(feature_set, scale, **{"binned": binned} | feature_options), learner])


def fit_out_of_fold(
    learner: Estimator, train: DataFrame, key: str = ROW_KEY, folds: int = 3, scale: bool = False
) -> PipelineModel:
    """Fit the ``full`` feature set without the training rows' own labels in their encodings.

    A plain fit encodes a training row with statistics that include its own label, so that the learner trusts
    rare categories too much. Here the learner is trained on out-of-fold encodings. The result is a pipeline like
    any other: it scores new rows with the encoder fitted on all training rows.
    """
    return training_pipeline(learner, "full", scale, out_of_fold=folds, key=key).fit(train)


class FittedLearners(NamedTuple):
    """Fitted learners by name, and the encoded rows of the test side that all of them score."""

    models: dict[str, Model]
    held_out: DataFrame


def fit_learners(
    learners: Mapping[str, Estimator], data: PreparedData, feature_set: str = "full", **feature_options
) -> FittedLearners:
    """All learners fitted on the same encoded rows.

    The feature stages are fitted once. Encoded rows of both sides are staged once; those of the training side are removed when
    the learners are fitted.
    """
    binned = any(one.getFeaturesCol() == BINNED_FEATURES for one in learners.values())
    options = {"binned": binned} | feature_options
    pipelines = {name: training_pipeline(one, feature_set, **options) for name, one in learners.items()}
    features = next(iter(pipelines.values())).fit_features(data.train)
    seen = dict.fromkeys(column for one in pipelines.values() for column in one.learner_columns()[:2])
    held_out = stage(features.transform(data.test).select(*seen), "encoded-test")
    with scratch(data.train.sparkSession):
        read = dict.fromkeys(column for one in pipelines.values() for column in one.learner_columns())
        encoded = stage_spread(features.encoded.select(*read), "encoded-train")
        with small_splits(data.train.sparkSession):
            models = {name: pipeline.fit_learner(encoded) for name, pipeline in pipelines.items()}
    return FittedLearners(models, held_out)


def compare_learners(
    learners: Mapping[str, Estimator], data: PreparedData, feature_set: str = "full", **feature_options
) -> dict[str, DataFrame]:
    """Scored test rows by learner, all fitted on the same encoded rows (:func:`fit_learners`)."""
    fitted = fit_learners(learners, data, feature_set, **feature_options)
    return {name: model.transform(fitted.held_out) for name, model in fitted.models.items()}
