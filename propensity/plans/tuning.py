"""Training pipelines and cross-validated search over them."""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.param import Param
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.operators.metrics import area_under_roc
from propensity.operators.splitting import with_fold
from propensity.operators.target_encoding import AutoTargetEncoder, encode_with_all, label_counts
from propensity.plans.evaluation import with_score
from propensity.plans.forests import KeyedForest, SharedBoosting, in_threads, prefix_areas
from propensity.plans.paths import Penalty, fit_paths, linear_areas
from propensity.schema import LABEL, ROW_KEY
from propensity.session import scratch, small_splits
from propensity.sources.tables import stage, stage_spread

FOLD, ENCODINGS = "fold", "__encodings"


class FittedFeatures(NamedTuple):
    """Fitted feature stages, and the training rows as the learner is to see them."""

    stages: list[Transformer]
    encoded: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        for fitted in self.stages:
            df = fitted.transform(df)
        return df


class TrainingPipeline(Pipeline):
    """Feature stages with a learner behind them.

    Fitting differs from that of a plain pipeline in two ways:

    * A stage that reads columns of the training table learns from that table, not through the stages before it:
      the plan of a category count has no join in it.
    * A target encoder with out-of-fold folds hands on training rows encoded without their own label.

    The learner sees the rows as they lie: one task per partition of its input. Models do not depend on that layout, since the learners of
    this library draw nothing by partition (:class:`propensity.plans.forests.KeyedForest`, :class:`propensity.operators.QuantileBins`).
    """

    @keyword_only
    def __init__(self, *, stages=None):
        super().__init__(stages=stages)

    def learner(self) -> Estimator:
        return self.getStages()[-1]

    def learner_columns(self) -> list[str]:
        """Columns that the learner reads."""
        learner = self.learner()
        names = [learner.getFeaturesCol(), learner.getLabelCol()]
        if learner.isDefined("weightCol") and learner.getOrDefault("weightCol"):
            names.append(learner.getOrDefault("weightCol"))
        return names + (learner.extra_columns() if isinstance(learner, KeyedForest) else [])

    def fit_features(self, train: DataFrame) -> FittedFeatures:
        """Fit all stages but the learner."""
        encoded, fitted = train, []
        for part in self.getStages()[:-1]:
            if not isinstance(part, Estimator):
                model = part
            else:
                model = part.fit(train if _inputs_of(part) <= set(train.columns) else encoded)
            fitted.append(model)
            if isinstance(part, AutoTargetEncoder):
                encoded = part.encode_training(encoded, model)
            else:
                encoded = model.transform(encoded)
        return FittedFeatures(fitted, encoded)

    def fit_learner(self, encoded: DataFrame, params: dict | None = None) -> Model:
        """Fit the learner on encoded rows."""
        return self.learner().fit(encoded.select(*self.learner_columns()), params or {})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        features = self.fit_features(dataset)
        with small_splits(dataset.sparkSession):
            return PipelineModel([*features.stages, self.fit_learner(features.encoded)])


def _inputs_of(part: Estimator) -> set[str]:
    names = []
    for param in ("inputCol", "inputCols", "labelCol"):
        if part.hasParam(param) and part.isDefined(param):
            value = part.getOrDefault(param)
            names += [value] if isinstance(value, str) else value
    return set(names)


def full_logistic_grid(learner: LogisticRegression) -> list[dict]:
    """The complete grid of the logistic search: penalty x regularization x iterations.

    l1, l2 and elastic net are the mixing parameter 1, 0 and 0.5; no penalty is a regularization of 0, where
    the mixing does not matter. Solvers are not a choice in Spark. That leaves 244 distinct points.
    """
    # Fixed values of the search space.
    strengths = [float(value) for value in np.logspace(-4, 4, 20)]
    iterations = [100, 1000, 2500, 5000]
    penalized = (
        ParamGridBuilder()
        .addGrid(learner.elasticNetParam, [1.0, 0.0, 0.5])
        .addGrid(learner.regParam, strengths)
        .addGrid(learner.maxIter, iterations)
        .build()
    )
    free = (
        ParamGridBuilder().addGrid(learner.regParam, [0.0]).addGrid(learner.maxIter, iterations).build()
    )
    return penalized + free


def exact_area(model: Model, encoded: DataFrame) -> float:
    """Area under ROC of a learner on encoded rows."""
    area = area_under_roc(with_score(model.transform(encoded)), LABEL, "score").first()["auc"]
    if area is None:
        raise ValueError("a fold has rows of one class only")
    return area


def _settings(learner: Estimator, params: dict) -> tuple:
    """What of a grid point concerns the feature stages, by names."""
    return tuple(
        sorted((param.parent, param.name, str(value)) for param, value in params.items() if param.parent != learner.uid)
    )


def _own(learner: Estimator, params: dict) -> dict:
    return {param: value for param, value in params.items() if param.parent == learner.uid}


def _size_of(learner: Estimator) -> Param | None:
    """The parameter by which an ensemble of the learner is the beginning of a larger one."""
    if isinstance(learner, KeyedForest):
        return learner.numTrees
    return learner.maxIter if isinstance(learner, GBTClassifier) else None


def _staged_folds(
    pipeline: TrainingPipeline, grid: list[dict], train: DataFrame, key: str, folds: int, parallelism: int
) -> dict[tuple[int, tuple], tuple[DataFrame, DataFrame]]:
    """Encoded rows of both sides by fold and setting of the feature stages."""
    learner = pipeline.learner()
    spark = train.sparkSession
    folded = with_fold(train, key, folds, FOLD)
    settings = {
        _settings(learner, params): pipeline.copy({param: value for param, value in params.items() if param.parent != learner.uid})
        for params in grid
    }
    columns = list(dict.fromkeys(pipeline.learner_columns()))
    parts = [(fold, name) for fold in range(folds) for name in settings]
    encoders = [stage for stage in pipeline.getStages() if isinstance(stage, AutoTargetEncoder)]
    honest = any(stage.getOrDefault("outOfFold") for own in settings.values() for stage in own.getStages()[:1] if encoders)
    if len(encoders) == 1 and pipeline.getStages()[0] is encoders[0] and not honest:
        counts = stage(label_counts(folded, encoders[0].getInputCol(), encoders[0].getLabelCol(), FOLD), "fold-counts")
        wide = dict(zip(settings, in_threads(spark, parallelism, _fold_wide, [(own, folded, counts, folds) for own in settings.values()])))

        def view(fold: int, name: tuple) -> tuple[DataFrame, DataFrame]:
            return _fold_of(settings[name], wide[name], fold, columns)

        return dict(zip(parts, in_threads(spark, parallelism, view, parts)))

    def encode(fold: int, name: tuple) -> tuple[DataFrame, DataFrame]:
        features = settings[name].fit_features(folded.filter(f"{FOLD} != {fold}").drop(FOLD))
        held_out = features.transform(folded.filter(f"{FOLD} = {fold}").drop(FOLD))
        return stage_spread(features.encoded.select(*columns), "fold-train"), stage(held_out.select(*columns[:2]), "fold-test")

    return dict(zip(parts, in_threads(spark, parallelism, encode, parts)))


def _fold_wide(pipeline: TrainingPipeline, folded: DataFrame, counts: DataFrame, folds: int) -> DataFrame:
    """All rows, staged once for all folds: each has the encoding that every fold's encoder gives it, in an array.

    The encoders are fitted on counts per category, label and fold, not on rows. Stages that learn nothing are applied here as well.
    """
    encoder = pipeline.getStages()[0]
    fit = encoder.copy({encoder.countCol: "__count"}).fit
    models = [fit(counts.filter(f"{FOLD} != {fold}")) for fold in range(folds)]
    rows = encode_with_all(folded, models, ENCODINGS)
    for part in pipeline.getStages()[1:-1]:
        if isinstance(part, Estimator):
            break
        rows = part.transform(rows)
    return stage_spread(rows, "fold-rows", partition_by=FOLD)


def _fold_of(pipeline: TrainingPipeline, wide: DataFrame, fold: int, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a fold as views of the wide table; what is left to do is cheap next to reading it."""
    output = pipeline.getStages()[0].getOutputCol()
    rows = wide.withColumn(output, F.get(ENCODINGS, F.lit(fold))).drop(ENCODINGS)
    train, held_out = rows.filter(f"{FOLD} != {fold}").drop(FOLD), rows.filter(f"{FOLD} = {fold}").drop(FOLD)
    learnt = False
    for part in pipeline.getStages()[1:-1]:
        learnt = learnt or isinstance(part, Estimator)
        if learnt:
            model = part.fit(train) if isinstance(part, Estimator) else part
            train, held_out = model.transform(train), model.transform(held_out)
    return train.select(*columns), held_out.select(*columns[:2])


def _searched(
    pipeline: TrainingPipeline, grid: list[dict], train: DataFrame, folds: int, areas: np.ndarray
) -> CrossValidatorModel:
    """The best point of ``areas`` (``[fold, point]``), refitted on all rows."""
    averages = areas.mean(axis=0).tolist()
    best = pipeline.fit(train, grid[int(np.argmax(averages))])
    model = CrossValidatorModel(best, avgMetrics=averages, stdMetrics=areas.std(axis=0).tolist())
    return model._set(estimator=pipeline, estimatorParamMaps=grid, numFolds=folds)


def cross_validate(
    pipeline: TrainingPipeline,
    grid: list[dict],
    train: DataFrame,
    key: str = ROW_KEY,
    folds: int = 3,
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Search ``grid`` by mean exact area under ROC over key-hashed folds and refit the best point on all rows.

    Where the target encoder comes first, as in the full feature set, rows are counted once per category, label and fold; all folds' encoders are
    fitted on these counts, and all rows are written to the shared folder once, with the encodings of every fold. Folds are read as filters of that
    table. Otherwise both sides of each fold are written once. All points use what is written; it is removed at the end. Nothing is
    cached. Points of a forest or of boosting that differ only in the number of trees are one fit, of the largest; the
    held-out rows are scored once for all of them (:func:`propensity.plans.forests.prefix_areas`), as they are for all points of a logistic
    regression (:func:`propensity.plans.paths.linear_areas`). All boosting fits of a fold grow in shared passes
    (:meth:`propensity.plans.forests.SharedBoosting.areas_together`). ``parallelism`` is the number of jobs that run at a time; the scheduler shares the cores.
    """
    spark = train.sparkSession
    learner = pipeline.learner()
    size = _size_of(learner)
    linear = isinstance(learner, LogisticRegression) and learner.getFamily() != "multinomial"
    boosting = isinstance(learner, SharedBoosting)

    def alike(point: int) -> tuple:
        """What points that one fit serves have in common."""
        return tuple(sorted((param.name, str(value)) for param, value in _own(learner, grid[point]).items() if param != size))

    groups: dict[tuple, list[int]] = {}
    for point, params in enumerate(grid):
        own = () if linear or boosting else alike(point) if size else point
        groups.setdefault((_settings(learner, params), own), []).append(point)

    def evaluate(fold: int, points: list[int]) -> dict[int, float]:
        rows, held_out = encoded[fold, _settings(learner, grid[points[0]])]
        if linear:  # held-out rows are read and their areas summed up once for all points
            models = [pipeline.fit_learner(rows, _own(learner, grid[point])) for point in points]
            parameters = np.array([[model.intercept, *model.coefficients.toArray()] for model in models])
            return dict(zip(points, linear_areas(held_out, parameters, *pipeline.learner_columns()[:2]).tolist()))
        if size is None:
            return {points[0]: exact_area(pipeline.fit_learner(rows, _own(learner, grid[points[0]])), held_out)}
        sizes = {point: grid[point].get(size, learner.getOrDefault(size)) for point in points}
        runs: dict[tuple, list[int]] = {}
        for point in points:
            runs.setdefault(alike(point), []).append(point)
        counts = [[sizes[point] for point in run] for run in runs.values()]
        largest = [_own(learner, grid[max(run, key=sizes.get)]) for run in runs.values()]
        if boosting:
            areas = learner.areas_together(rows.select(*pipeline.learner_columns()), held_out, largest, counts)
        else:
            areas = [prefix_areas(pipeline.fit_learner(rows, own), held_out, sized, LABEL) for own, sized in zip(largest, counts)]
        return {point: area for run, own in zip(runs.values(), areas) for point, area in zip(run, own)}

    with scratch(spark):
        encoded = _staged_folds(pipeline, grid, train, key, folds, parallelism)
        tasks = [(fold, points) for fold in range(folds) for points in groups.values()]
        with small_splits(spark):
            found = in_threads(spark, parallelism, evaluate, tasks)
    areas = np.empty((folds, len(grid)))
    for (fold, _), by_point in zip(tasks, found):
        for point, area in by_point.items():
            areas[fold, point] = area
    return _searched(pipeline, grid, train, folds, areas)


def search_logistic_grid(
    pipeline: TrainingPipeline,
    grid: list[dict],
    train: DataFrame,
    key: str = ROW_KEY,
    folds: int = 3,
    parallelism: int = 4,
) -> CrossValidatorModel:
    """:func:`cross_validate` for large grids of penalties and iteration limits of logistic regression.

    All penalties of a fold are fitted in shared passes (:func:`propensity.plans.paths.fit_paths`), the limits are read off their iterates, and
    one scan of the held-out rows gives the areas of all of them. The fits are converged ones: a limit matters where it ends the
    Newton steps of a run, which take far fewer iterations than gradient steps. The best point is refitted with the learner itself.
    """
    spark = train.sparkSession
    learner = pipeline.learner()
    if not isinstance(learner, LogisticRegression) or not (learner.getFitIntercept() and learner.getStandardization()):
        raise ValueError("the search is for logistic regression with an intercept and standardized features")

    def value(params: dict, param: Param):
        return params.get(param, learner.getOrDefault(param))

    def penalty(params: dict) -> Penalty:
        strength = float(value(params, learner.regParam))
        return Penalty(strength, float(value(params, learner.elasticNetParam)) if strength else 0.0)

    names = [_settings(learner, params) for params in grid]
    limits = sorted({int(value(params, learner.maxIter)) for params in grid})

    def evaluate(fold: int, name: tuple) -> dict[int, float]:
        rows, held_out = encoded[fold, name]
        points = [i for i, own in enumerate(names) if own == name]
        penalties = list(dict.fromkeys(penalty(grid[i]) for i in points))
        columns = pipeline.learner_columns()
        fitted = fit_paths(rows, penalties, limits, *columns[:2], *columns[2:3])
        places = [(penalties.index(penalty(grid[i])), limits.index(int(value(grid[i], learner.maxIter)))) for i in points]
        parameters = np.stack([fitted.parameters[place] for place in places])
        return dict(zip(points, linear_areas(held_out, parameters, *columns[:2]).tolist()))

    with scratch(spark):
        encoded = _staged_folds(pipeline, grid, train, key, folds, parallelism)
        tasks = list(encoded)
        with small_splits(spark):
            found = in_threads(spark, parallelism, evaluate, tasks)
    areas = np.empty((folds, len(grid)))
    for (fold, _), by_point in zip(tasks, found):
        for point, area in by_point.items():
            areas[fold, point] = area
    return _searched(pipeline, grid, train, folds, areas)


def search_table(spark: SparkSession, model: CrossValidatorModel) -> DataFrame:
    """Grid points as rows ``(params, avg_metric, rank)``; rank 1 is the model that was kept."""
    points = [
        (json.dumps({param.name: value for param, value in params.items()}, sort_keys=True), float(metric))
        for params, metric in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]
    ordered = sorted(points, key=lambda point: -point[1])
    rows = [(params, metric, rank) for rank, (params, metric) in enumerate(ordered, start=1)]
    return spark.createDataFrame(rows, "params string, avg_metric double, rank bigint")
