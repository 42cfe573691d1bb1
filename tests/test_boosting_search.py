"""Boosting fits that share passes: the same as fits on their own, in the jobs of one of them."""

import numpy as np
import pytest
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from propensity.plans import cross_validate, gradient_boosted_trees, shared_boosting, training_pipeline
from propensity.plans.forests import prefix_areas
from propensity.plans.shared_boosting import Piece, dealt
from propensity.schema import LABEL, ROW_KEY
from propensity.sources import stage

COLUMNS = ["x0", "x1", "flag"]


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(8000).select(
        F.col("id").alias(ROW_KEY), *(F.abs(F.hash("id", F.lit(i))).cast("double").alias(f"x{i}") for i in range(2)),
        (F.col("id") % 3 == 0).cast("double").alias("flag"), F.when(F.col("id") % 5 == 0, 0.8).otherwise(0.2).alias("weight_col"),
    )
    chance = 0.2 + 0.4 * F.col("x0") / 2**31 + 0.2 * F.col("flag")
    return made.withColumn(LABEL, (F.abs(F.hash(ROW_KEY, F.lit(9))) / 2**31 < chance).cast("double"))


@pytest.fixture(scope="module")
def given(rows):
    pipeline = training_pipeline(gradient_boosted_trees(), "columns", columns=COLUMNS)
    return stage(pipeline.fit_features(rows).encoded.select(*pipeline.learner_columns()), "search-test")


def jobs(spark, group, call):
    spark.sparkContext.setJobGroup(group, "counted")
    call()
    spark.sparkContext.setJobGroup("other", "not counted")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_search_over_depths_takes_the_passes_of_the_deepest(spark, rows):
    learner = gradient_boosted_trees(6)
    pipeline = training_pipeline(learner, "columns", columns=COLUMNS)

    def search(*depths):
        grid = ParamGridBuilder().addGrid(learner.maxDepth, list(depths)).addGrid(learner.maxIter, [3, 6]).build()
        return lambda: cross_validate(pipeline, grid, rows, folds=2)

    assert jobs(spark, "both", search(2, 4)) <= jobs(spark, "deepest", search(4)) + 4


def test_areas_of_shared_fits_are_those_of_fits_alone(given):
    learner = gradient_boosted_trees(6)
    held_out = given.select("binned_features", LABEL)
    params = [{learner.maxDepth: 2}, {learner.maxDepth: 4, learner.maxIter: 3}, {learner.maxDepth: 3, learner.stepSize: 0.5}]
    sizes = [[2, 6], [3], [6, 1]]
    found = learner.areas_together(given, held_out, params, sizes)
    for own, sized, areas in zip(params, sizes, found):
        assert areas == pytest.approx(prefix_areas(learner.fit(given, own), held_out, sized, LABEL), abs=1e-12)


def test_a_fit_that_is_sparks_to_do_stands_beside_shared_ones(given):
    learner = gradient_boosted_trees(3)
    held_out = given.select("binned_features", LABEL)
    params = [{learner.maxDepth: 2}, {learner.maxDepth: 2, learner.subsamplingRate: 0.5}]
    found = learner.areas_together(given, held_out, params, [[3], [2]])
    assert found[1] == prefix_areas(learner.fit(given, params[1]), held_out, [2], LABEL)


def test_trees_do_not_depend_on_how_sums_are_merged(given, monkeypatch):
    whole = gradient_boosted_trees(4).fit(given)
    monkeypatch.setattr(shared_boosting, "BLOCK_ROWS", 512)
    monkeypatch.setattr(shared_boosting, "MOST_ROWS", 900)
    monkeypatch.setattr(shared_boosting, "SUMS_BYTES", 0)
    parts = gradient_boosted_trees(4).fit(given)
    raw = [np.array([row[0][1] for row in model.transform(given).select("rawPrediction").collect()]) for model in (whole, parts)]
    assert np.abs(raw[0] - raw[1]).max() < 1e-9


def test_parts_hold_every_piece_once_and_are_bounded():
    pieces = [Piece("f", i, 50_000 + i) for i in range(200)]
    parts = dealt(pieces, 2)
    assert sorted(piece.start for part in parts for piece in part) == list(range(200))
    assert len(parts) == 5 and max(sum(piece.rows for piece in part) for part in parts) < 1.1 * shared_boosting.MOST_ROWS
    assert len(dealt(pieces[:1], 8)) == 1 and len(dealt([Piece("f", i, 1000) for i in range(8)], 8)) == 1
