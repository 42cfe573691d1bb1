"""Regressions fitted together against Spark's own."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from propensity.appointments import appointments
from propensity.operators import area_under_roc, with_fold
from propensity.plans import (
    Penalty,
    fit_paths,
    full_logistic_grid,
    linear_areas,
    logistic_regression,
    prepare,
    search_logistic_grid,
    training_pipeline,
)
from propensity.schema import LABEL, ROW_KEY
from propensity.sources import stage

PENALTIES = [Penalty(0.0, 0.0), Penalty(0.01, 0.0), Penalty(1.0, 0.0), Penalty(0.003, 1.0), Penalty(0.03, 0.5), Penalty(10.0, 1.0)]


@pytest.fixture(scope="module")
def data(spark):
    return prepare(appointments(spark, "/root/testdata/sf0.01"))


@pytest.fixture(scope="module")
def rows(data):
    features = training_pipeline(logistic_regression()).fit_features(data.train)
    return stage(features.encoded.select("features", LABEL, "weight_col"), "path-rows")


def own_fit(rows, penalty, weight="weight_col"):
    learner = LogisticRegression(
        featuresCol="features", labelCol=LABEL, regParam=penalty.strength, elasticNetParam=penalty.mixing, maxIter=500, tol=1e-12
    )
    model = (learner.setWeightCol(weight) if weight else learner).fit(rows)
    return np.array([model.intercept, *model.coefficients])


def test_equals_the_fits_of_the_learner(rows):
    fit = fit_paths(rows, PENALTIES, [100, 5000], label=LABEL, weight="weight_col")
    assert fit.converged.all() and fit.passes < 30
    for penalty, found in zip(PENALTIES, fit.parameters):
        expected = own_fit(rows, penalty)
        assert np.abs(found[0] - expected).max() < 1e-4 * max(1, np.abs(expected).max())
        assert (found[0] == found[1]).all()
        if penalty.mixing:
            assert ((found[0] == 0) == (np.abs(expected) < 1e-9)).all()
    assert not fit.parameters[-1, 0, 1:].any()


def test_without_weights(rows):
    penalty = Penalty(0.05, 0.2)
    found = fit_paths(rows, [penalty], [100], label=LABEL).parameters[0, 0]
    assert np.abs(found - own_fit(rows, penalty, None)).max() < 1e-4


def test_limits_hold_the_iterates(rows):
    fit = fit_paths(rows, [Penalty(0.001, 0.0)], [1, 2, 50], label=LABEL, weight="weight_col")
    one, two, end = fit.parameters[0]
    assert 0 < np.abs(two - end).max() < np.abs(one - end).max()
    stopped = fit_paths(rows, [Penalty(0.001, 0.0)], [2], label=LABEL, weight="weight_col")
    assert np.abs(stopped.parameters[0, 0] - two).max() < 1e-12 and not stopped.converged.any()


def test_constant_features_and_separable_rows(spark):
    points = [(float(i), float(i >= 5), 1.0) for i in range(10)]
    table = spark.createDataFrame([(Vectors.dense(x, 3.0), y, w) for x, y, w in points], ["features", "label", "w"])
    fit = fit_paths(table, [Penalty(0.0, 0.0), Penalty(0.1, 0.0)], [40], weight="w")
    assert (fit.parameters[:, 0, 2] == 0).all()
    assert np.isfinite(fit.parameters).all() and fit.parameters[0, 0, 1] > fit.parameters[1, 0, 1] > 0
    assert linear_areas(table, fit.parameters[:, 0]).tolist() == [1.0, 1.0]
    with pytest.raises(ValueError, match="weight"):
        fit_paths(table.withColumn("w", F.lit(0.0)), [Penalty(0.1, 0.0)], [5], weight="w")


def test_areas_of_models_in_one_scan(rows):
    models = np.stack([own_fit(rows, PENALTIES[1]), own_fit(rows, PENALTIES[-1]), -own_fit(rows, PENALTIES[1])])
    found = linear_areas(rows, models[[0, 1, 2, 0]], label=LABEL)
    x = vector_to_array("features")
    margin = F.aggregate(F.zip_with(x, F.lit(models[0, 1:].tolist()), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    expected = area_under_roc(rows.withColumn("s", margin), LABEL, "s").first()["auc"]
    assert found[0] == pytest.approx(expected, abs=1e-9) and found[0] == found[3]
    assert found[1] == 0.5 and found[2] == pytest.approx(1 - expected, abs=1e-9)


def test_search_equals_separate_fits_at_spot_points(data):
    learner = logistic_regression()
    grid = full_logistic_grid(learner)
    search = search_logistic_grid(training_pipeline(learner, "backup17"), grid, data.train, folds=2)
    assert len(search.avgMetrics) == 244
    folded = with_fold(data.train, ROW_KEY, 2)
    spots = [0, 37, 61, 90, 130, 170, 200, 243]
    sums = dict.fromkeys(spots, 0.0)
    for fold in range(2):
        pipeline = training_pipeline(learner, "backup17")
        features = pipeline.fit_features(folded.filter(F.col("fold") != fold))
        train = stage(features.encoded.select(*pipeline.learner_columns()), "spot-train")
        held_out = stage(features.transform(folded.filter(F.col("fold") == fold)).select("features", LABEL), "spot-test")
        for spot in spots:
            model = learner.copy(grid[spot]).fit(train)
            scored = model.transform(held_out).withColumn("s", vector_to_array("rawPrediction")[1])
            sums[spot] += area_under_roc(scored, LABEL, "s").first()["auc"] / 2
    assert {spot: search.avgMetrics[spot] for spot in spots} == {spot: pytest.approx(sums[spot], abs=1e-4) for spot in spots}
    assert search.bestModel.stages[-1].getRegParam() == grid[int(np.argmax(search.avgMetrics))][learner.regParam]


def test_encoders_may_be_part_of_the_grid(data):
    learner = logistic_regression()
    pipeline = training_pipeline(learner)
    smoothing = pipeline.getStages()[0].smoothing
    grid = ParamGridBuilder().addGrid(smoothing, ["auto", 50.0]).addGrid(learner.regParam, [0.01, 0.1]).build()
    assert len(search_logistic_grid(pipeline, grid, data.train, folds=2).avgMetrics) == 4
    with pytest.raises(ValueError, match="intercept"):
        search_logistic_grid(training_pipeline(learner.copy().setFitIntercept(False)), grid, data.train)
