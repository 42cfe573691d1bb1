"""Trees grown in shared passes against Spark's own learners."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from propensity.plans import random_forest, training_pipeline
from propensity.plans.forests import drawn_rows, poisson_draw, tree_hash
from propensity.plans.shared_trees import BLOCK_ROWS, bins_of, stage_blocks
from propensity.schema import LABEL, ROW_KEY
from propensity.sources import stage

COLUMNS = ["x0", "x1", "x2", "flag"]


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(30_000).select(
        F.col("id").alias(ROW_KEY), *(F.pow(F.abs(F.hash("id", F.lit(i))) / 2**31, 3).alias(f"x{i}") for i in range(3)),
        (F.col("id") % 3 == 0).cast("double").alias("flag"), F.when(F.col("id") % 5 == 0, 0.8).otherwise(0.2).alias("weight_col"),
    )
    chance = 0.2 + 0.4 * F.col("x0") + 0.2 * F.col("flag")
    return made.withColumn(LABEL, (F.abs(F.hash(ROW_KEY, F.lit(9))) / 2**31 < chance).cast("double"))


def encoded(learner, rows):
    pipeline = training_pipeline(learner, "columns", columns=COLUMNS)
    return stage(pipeline.fit_features(rows).encoded.select(*pipeline.learner_columns()), "shared-test")


def texts(model):
    return [tree.toDebugString.split("\n", 1)[1] for tree in model.trees]


def jobs(spark, call):
    spark.sparkContext.setJobGroup("shared-trees", "counted")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("shared-trees"))
    call()
    spark.sparkContext.setJobGroup("other", "not counted")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("shared-trees")) - before


def test_a_forest_takes_a_pass_per_level_however_many_trees_it_has(spark, rows):
    forest = random_forest(30, depth=4)
    given = encoded(forest, rows)
    few, many = jobs(spark, lambda: random_forest(3, depth=4).fit(given)), jobs(spark, lambda: forest.fit(given))
    assert few == many < 30


@pytest.mark.parametrize("strategy", ["sqrt", "all"])
def test_trees_without_bootstrap_are_sparks(rows, strategy):
    forest = random_forest(1, depth=5, bootstrap=False, columns_per_split=strategy)
    given = encoded(forest, rows)
    smallest = given.agg(F.min("weight_col")).first()[0]
    whole = given.withColumn("weight_col", F.round(F.col("weight_col") / smallest))
    own = RandomForestClassifier(
        featuresCol="binned_features", labelCol=LABEL, weightCol="weight_col", numTrees=1, bootstrap=False,
        featureSubsetStrategy=strategy, maxDepth=5, maxBins=256, seed=forest.getSeed(),
    ).fit(whole)
    assert texts(forest.fit(given)) == texts(own)


def test_blocks_are_bounded_and_hold_every_row(rows):
    given = encoded(random_forest(3), rows)
    bins = bins_of(given, "binned_features", 256)
    blocks = stage_blocks(given.coalesce(1), bins, "binned_features", LABEL, F.col("weight_col"))
    sizes = [row["rows"] for row in blocks.select("rows").collect()]
    assert sum(sizes) == given.count() and max(sizes) <= 2 * BLOCK_ROWS and len(sizes) > 1
    assert sorted(f for group in bins.groups for f in group) == list(range(4))


def test_draws_of_blocks_are_those_of_columns(spark):
    hashed = spark.range(2000).select((F.col("id") * 1_000_003).alias("h"))
    wanted = np.array(hashed.select(*(poisson_draw(tree_hash(F.col("h"), t)).alias(f"t{t}") for t in range(3))).collect())
    packed = drawn_rows(3)(np.arange(2000) * 1_000_003)
    assert packed.shape == (2, 2000)
    for tree in range(3):
        assert (packed[tree // 2] >> 4 * (tree % 2) & 15 == wanted[:, tree]).all()
