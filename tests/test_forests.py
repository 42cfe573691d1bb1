"""Forests from row keys, bins, and ensembles cut short."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from propensity.appointments import appointments
from propensity.functions.keyhash import key_hash
from propensity.operators import QuantileBins, quantile_edges, with_fold
from propensity.plans import (
    KeyedForest,
    cross_validate,
    gradient_boosted_trees,
    model_metrics,
    poisson_draw,
    prefix_areas,
    prepare,
    random_forest,
    training_pipeline,
)
from propensity.plans.forests import leaf_values, tree_hash
from propensity.schema import LABEL, ROW_KEY
from propensity.session import scratch_path
from propensity.sources import load_pipeline, save_pipeline, stage


@pytest.fixture(scope="module")
def data(spark):
    return prepare(appointments(spark, "/root/testdata/sf0.01"))


def encoded(learner, rows, feature_set="base8"):
    pipeline = training_pipeline(learner, feature_set)
    return stage(pipeline.fit_features(rows).encoded.select(*pipeline.learner_columns()), "forest-test")


def probabilities(model, rows):
    return dict(map(tuple, model.transform(rows).select(ROW_KEY, vector_to_array("probability")[1]).collect()))


def test_draws_are_poisson_and_independent(spark):
    hashed = spark.range(200_000).select(key_hash(F.col("id")).alias("h"))
    drawn = hashed.select(*(tree_hash(F.col("h"), t).alias(f"h{t}") for t in range(6))).select(
        *(poisson_draw(F.col(f"h{t}")).alias(f"t{t}") for t in range(6))
    )
    table = np.array(drawn.collect(), float)
    assert np.abs(table.mean(axis=0) - 1).max() < 0.02 and np.abs(table.var(axis=0) - 1).max() < 0.03
    assert np.abs(np.corrcoef(table.T) - np.eye(6)).max() < 0.015
    for count in range(5):
        assert (table == count).mean(axis=0) == pytest.approx(np.full(6, math.exp(-1) / math.factorial(count)), abs=0.005)
    squares = np.corrcoef(((table - 1) ** 2).T) - np.eye(6)
    assert np.abs(squares).max() < 0.02


@pytest.mark.parametrize("make", [lambda: random_forest(6), lambda: gradient_boosted_trees(5)], ids=["forest", "boosting"])
def test_models_do_not_depend_on_layout(data, make):
    found = []
    for parts in (1, 4, 64):
        train = data.train.repartition(parts)
        found.append(probabilities(training_pipeline(make(), "backup17").fit(train), data.test))
    for other in found[1:]:
        assert other.keys() == found[0].keys() and len(other) > 2000
        assert max(abs(other[key] - found[0][key]) for key in other) < 1e-9


def test_layout_does_not_matter_where_split_candidates_are_sampled(spark):
    """Beyond 65,536 rows the learners look at a sample of rows for candidates, drawn by partition."""
    rows = spark.range(120_000).select(
        F.col("id").alias(ROW_KEY), *(F.pow(F.abs(F.hash("id", F.lit(i))) / 2**31, 3).alias(f"x{i}") for i in range(3))
    )
    rows = rows.withColumn(LABEL, (F.abs(F.hash(ROW_KEY, F.lit(9))) / 2**31 < 0.3 + 0.4 * F.col("x0")).cast("double"))
    scores = []
    for parts in (2, 9):
        pipeline = training_pipeline(random_forest(2, weight=None), "columns", columns=["x0", "x1", "x2"])
        scores.append(probabilities(pipeline.fit(rows.repartition(parts)), rows.filter("appointment_id < 3000")))
    assert max(abs(scores[0][key] - scores[1][key]) for key in scores[0]) < 1e-12


def test_a_tree_is_the_learners_own_tree_over_the_drawn_rows(data):
    forest = random_forest(3, depth=4)
    rows = encoded(forest, data.train)
    model = forest.fit(rows)
    assert isinstance(forest, RandomForestClassifier) and model.getNumTrees == 3 and model.getMaxDepth() == 4
    smallest = rows.agg(F.min("weight_col")).first()[0]
    drawn = rows.withColumn("h", tree_hash(key_hash(F.col(ROW_KEY)), 1)).withColumn(
        "w", F.round(F.col("weight_col") / smallest) * poisson_draw(F.col("h"))
    )
    alone = RandomForestClassifier(
        featuresCol="binned_features", labelCol=LABEL, weightCol="w", numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt",
        maxDepth=4, maxBins=256, seed=forest.getSeed() + 1,
    ).fit(drawn.filter("w > 0"))
    assert alone.trees[0].toDebugString.split("\n", 1)[1] == model.trees[1].toDebugString.split("\n", 1)[1]


def test_smaller_forests_are_beginnings_of_larger_ones(data):
    rows = encoded(random_forest(), data.train)
    large, small = random_forest(5).fit(rows), random_forest(2).fit(rows)
    assert [t.toDebugString.split("\n", 1)[1] for t in large.trees[:2]] == [t.toDebugString.split("\n", 1)[1] for t in small.trees]


@pytest.mark.parametrize("make", [random_forest, gradient_boosted_trees], ids=["forest", "boosting"])
def test_prefixes_have_the_metrics_of_separate_fits(data, make):
    learner = make(6)
    rows = encoded(learner, data.train)
    model = learner.fit(rows)
    assert len(leaf_values(model)) == 6
    found = prefix_areas(model, rows, [2, 6], LABEL)
    for size, area in zip((2, 6), found):
        own = make(size).fit(rows).transform(rows)
        assert area == pytest.approx(model_metrics(own, "m").filter("metric = 'auc'").first()["value"], abs=1e-9)
    with pytest.raises(ValueError, match="trees"):
        prefix_areas(model, rows, [7], LABEL)


@pytest.mark.parametrize("make", [random_forest, gradient_boosted_trees], ids=["forest", "boosting"])
def test_searches_fit_the_largest_of_a_group_only(data, make, monkeypatch):
    learner = make(5)
    size = learner.numTrees if isinstance(learner, KeyedForest) else learner.maxIter
    kind = KeyedForest if isinstance(learner, KeyedForest) else GBTClassifier
    fits, fit = [], kind._fit
    monkeypatch.setattr(kind, "_fit", lambda self, df: fits.append(self.getOrDefault(size.name)) or fit(self, df))
    grid = ParamGridBuilder().addGrid(learner.maxDepth, [2, 3]).addGrid(size, [2, 4]).build()
    search = cross_validate(training_pipeline(learner, "base8"), grid, data.train, folds=2)
    assert sorted(fits[:-1]) == [4, 4, 4, 4] and len(fits) == 5  # two depths, two folds, and the refit
    folded = with_fold(data.train, ROW_KEY, 2)
    areas = []
    for fold in range(2):
        one = training_pipeline(learner.copy(grid[0]), "base8").fit(folded.filter(F.col("fold") != fold))
        scored = one.transform(folded.filter(F.col("fold") == fold))
        areas.append(model_metrics(scored, "m").filter("metric = 'auc'").first()["value"])
    assert search.avgMetrics[0] == pytest.approx(np.mean(areas), abs=1e-9)


def test_saved_forest_takes_raw_columns(spark, data):
    model = training_pipeline(random_forest(3)).fit(data.train)
    path = scratch_path(spark, "forest")
    save_pipeline(model, path)
    loaded = load_pipeline(path)
    assert isinstance(loaded, PipelineModel) and loaded.stages[-1].getNumTrees == 3
    assert probabilities(loaded, data.test) == probabilities(model, data.test)


def test_forest_without_usable_rows(data):
    rows = encoded(random_forest(), data.train).withColumn("weight_col", F.lit(0.0))
    with pytest.raises(ValueError, match="weight"):
        random_forest(2).fit(rows)


def test_edges_are_quantiles(spark):
    rows = spark.range(6400).select(
        (F.col("id") % 640).cast("double").alias("even"), (F.col("id") % 3 - 1).alias("few"), F.lit(7).alias("constant"),
        F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit(-0.0)).alias("holes"), (F.col("id") == 0).cast("int").alias("rare"),
        F.when(F.col("id") < 3200, 0.0).otherwise(-F.exp(F.col("id") / 100)).alias("hot"),
    )
    even, few, constant, holes, rare, hot = quantile_edges(rows, rows.columns)
    assert len(even) == 31 and max(abs(edge - 20 * (i + 1)) for i, edge in enumerate(even)) <= 2
    assert few == [0.0, 1.0] and constant == holes == []
    assert rare == []  # less than one of 2,000 rows
    assert len(hot) == 16 and hot[-1] == 0.0 and all(a < b for a, b in zip(hot, hot[1:]))
    again = quantile_edges(rows.repartition(7), rows.columns)
    assert again == [even, few, constant, holes, rare, hot]


def test_bins_of_new_values(spark):
    rows = spark.createDataFrame([(float(i % 4), 5.0) for i in range(100)], "x double, c double")
    model = QuantileBins(inputCols=["x", "c"], outputCols=["xb", "cb"]).fit(rows)
    new = spark.createDataFrame([(-1e300, -9.0), (1.5, 5.0), (3.0, 1e300), (1e308, 0.0)], "x double, c double")
    assert [tuple(r) for r in model.transform(new).select("xb", "cb").collect()] == [(0, 0), (1, 0), (3, 0), (3, 0)]
    assert quantile_edges(rows.limit(0), ["x"]) == [[]]
