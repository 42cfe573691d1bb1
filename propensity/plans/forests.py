"""Forests whose trees depend on row keys and tree numbers only, and scores of ensembles cut short."""

from __future__ import annotations

import contextvars
import math
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.functions.keyhash import INCREMENT, MODULUS, MULTIPLIER, key_hash
from propensity.operators.curves import COUNTS, collapsed, counts_batch, curve_areas
from propensity.plans.shared_boosting import Fit, Scored, boost, scored, stage_pieces
from propensity.plans.shared_trees import (
    MOST_DRAWN,
    Bins,
    Seeds,
    Tree,
    bins_of,
    fits,
    grow_forest,
    java_trees,
    rules_of,
    stage_blocks,
)
from propensity.schema import ROW_KEY
from propensity.session import scratch
from propensity.sources.tables import stage

TREE_WEIGHT = "__tree_weight"
#: trees that are fitted at a time; the scheduler shares the cores
PARALLEL_TREES = 8
#: weights are multiples of this part of the least one, so that their sums are exact in any order
WEIGHT_STEPS = 1024


def tree_hash(row_hash: Column, tree: int) -> Column:
    """A number in [0, 2^31 - 1) from the hash of a row and a tree number; numbers of different trees are independent."""
    mixed = key_hash(row_hash.bitwiseXOR(F.lit((tree + 1) * 40_503)))
    return key_hash(F.shiftright(mixed, 9).bitwiseXOR(mixed))


def poisson_bounds() -> list[int]:
    """Where the draws 0 to 11 end; beyond the last, which less than one of 2^31 numbers is, lies 12."""
    total, term, bounds = 0.0, math.exp(-1), []
    for count in range(12):
        term = term / count if count else term
        total += term
        bounds.append(int(round(total * MODULUS)))
    return bounds


def poisson_draw(hashed: Column) -> Column:
    """How often a row occurs in a tree's sample: a Poisson draw of mean 1, the point of the distribution at which ``hashed`` lies.

    Beyond 12 lies less than one of 2^31 rows.
    """
    draw = None
    for count, bound in enumerate(poisson_bounds()):
        draw = F.when(hashed < bound, count) if draw is None else draw.when(hashed < bound, count)
    return draw.otherwise(12)


def drawn_rows(trees: int) -> Callable[[np.ndarray], np.ndarray]:
    """:func:`poisson_draw` of :func:`tree_hash` for all trees, from the key hashes of a block: ``[tree / 2, row]``, two trees in a byte."""
    bounds = np.array(poisson_bounds())

    def step(number: np.ndarray) -> np.ndarray:
        return (number % MODULUS * MULTIPLIER + INCREMENT) % MODULUS

    def draw(row_hash: np.ndarray) -> np.ndarray:
        packed = np.zeros(((trees + 1) // 2, len(row_hash)), np.uint8)
        for tree in range(trees):
            mixed = step(row_hash ^ ((tree + 1) * 40_503))
            often = np.searchsorted(bounds, step((mixed >> 9) ^ mixed), "right")
            packed[tree // 2] |= (np.minimum(often, MOST_DRAWN) << 4 * (tree % 2)).astype(np.uint8)
        return packed

    return draw


def in_threads(spark: SparkSession, parallelism: int, call: Callable, tasks: Iterable[tuple]) -> list:
    """Results of ``call(*task)`` in order; threads share the session's properties and the scratch scope."""
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        futures = [
            pool.submit(contextvars.copy_context().run, inheritable_thread_target(spark)(call), *task) for task in tasks
        ]
        return [future.result() for future in futures]


class KeyedForest(RandomForestClassifier):
    """Spark's random forest with the bootstrap taken from row keys.

    The forest of Spark draws each tree's rows by partition, so it changes with the layout of its input. Here tree number t is Spark's own
    single tree over all rows, each weighted by :func:`poisson_draw` from the hash of its key and t (and its own weight), with the seed ``seed + t`` for
    the choice of features. A forest of n trees is the beginning of any larger one. The fitted model is Spark's, and is saved and loaded as such.

    Over binned features all trees grow together: rows are staged once as blocks of codes, and a pass over these per level of depth gives the sums
    by which the open nodes of all trees are split (:mod:`propensity.plans.shared_trees`). Over other features, or where a level's sums exceed ``maxMemoryInMB``,
    each tree is a fit of its own over staged rows, side by side.

    Without bootstrap a tree sees every row once. ``row_key`` names the column of keys; rows need one.
    """

    row_key = ROW_KEY

    def extra_columns(self) -> list[str]:
        """Columns that fitting reads besides features, label and weight."""
        return [self.row_key] if self.getBootstrap() else []

    def taken_features(self, features: int) -> int:
        """Features that a node may split by; 0 for a strategy that only Spark knows."""
        strategy = self.getFeatureSubsetStrategy()
        if strategy == "auto":
            strategy = "sqrt" if self.getNumTrees() > 1 else "all"
        known = {"all": features, "sqrt": math.ceil(math.sqrt(features)), "onethird": math.ceil(features / 3)}
        return known.get(strategy, 0)

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        bins = bins_of(dataset, self.getFeaturesCol(), self.getMaxBins())
        taken = self.taken_features(len(bins.arities)) if bins else 0
        if self.getImpurity() != "gini" or not fits(self, bins, taken, exact=True):
            return self._fit_apart(dataset)
        spark, number = dataset.sparkSession, self.getNumTrees()
        weight = F.col(self.getWeightCol()) if self.isDefined("weightCol") and self.getWeightCol() else F.lit(1.0)
        rules = rules_of(self, exact=True)
        with scratch(spark):
            draws, key = (drawn_rows(number), key_hash(F.col(self.row_key))) if self.getBootstrap() else (None, None)
            blocks = stage_blocks(dataset.filter(weight > 0), bins, self.getFeaturesCol(), self.getLabelCol(), weight, draws, key)
            least = blocks.agg(F.min("least")).first()[0]
            if least is None:
                raise ValueError("no row with a weight to fit on")
            subsets = [Seeds(spark, self.getSeed() + tree, len(bins.arities), taken) for tree in range(number)]
            trees = grow_forest(blocks, bins, rules, subsets, least, WEIGHT_STEPS, self.getBootstrap())
        classes = spark.sparkContext._jvm.org.apache.spark.ml.classification
        fitted = classes.RandomForestClassificationModel(self.uid, java_trees(spark, trees, bins, rules), len(bins.arities), 2)
        model = self._copyValues(RandomForestClassificationModel(fitted))
        model._transfer_params_to_java()  # what the model says of itself comes from there
        return model

    def _fit_apart(self, dataset: DataFrame) -> RandomForestClassificationModel:
        spark = dataset.sparkSession
        given = F.col(self.getWeightCol()) if self.isDefined("weightCol") and self.getWeightCol() else F.lit(1.0)
        least = dataset.agg(F.min(F.when(given > 0, given))).first()[0]
        if least is None:
            raise ValueError("no row with a weight to fit on")
        exact = F.round(given / least * WEIGHT_STEPS) / WEIGHT_STEPS
        trees = range(self.getNumTrees())
        strategy = self.getFeatureSubsetStrategy()
        if strategy == "auto":  # a single tree would take it as all features
            strategy = "sqrt" if self.getNumTrees() > 1 else "all"
        labelled = {"ml_attr": {"type": "nominal", "vals": ["0.0", "1.0"]}}
        label = F.col(self.getLabelCol()).cast("double").alias(self.getLabelCol(), metadata=labelled)
        one = RandomForestClassifier(
            featuresCol=self.getFeaturesCol(),
            labelCol=self.getLabelCol(),
            weightCol=TREE_WEIGHT,
            numTrees=1,
            bootstrap=False,
            featureSubsetStrategy=strategy,
            maxDepth=self.getMaxDepth(),
            maxBins=self.getMaxBins(),
            minInstancesPerNode=self.getMinInstancesPerNode(),
            minInfoGain=self.getMinInfoGain(),
            minWeightFractionPerNode=self.getMinWeightFractionPerNode(),
            impurity=self.getImpurity(),
            maxMemoryInMB=self.getMaxMemoryInMB(),
        )

        def fit_tree(number: int) -> RandomForestClassificationModel:
            weight = F.col("weight") * F.col(f"tree_{number}") if self.getBootstrap() else F.col("weight")
            rows = staged.select(F.col(self.getFeaturesCol()), label, weight.alias(TREE_WEIGHT))
            return one.copy({one.seed: self.getSeed() + number}).fit(rows.filter(F.col(TREE_WEIGHT) > 0))

        with scratch(spark):  # every tree makes several passes
            columns = [self.getFeaturesCol(), self.getLabelCol(), exact.cast("double").alias("weight")]
            if self.getBootstrap():
                # a column per tree: a pass reads its own only, and all trees run the same generated code
                hashed = dataset.withColumn("row_hash", key_hash(F.col(self.row_key)))
                hashed = hashed.withColumns({f"hash_{number}": tree_hash(F.col("row_hash"), number) for number in trees})
                columns += [poisson_draw(F.col(f"hash_{number}")).cast("byte").alias(f"tree_{number}") for number in trees]
                staged = stage(hashed.select(*columns), "forest-rows")
            else:
                staged = stage(dataset.select(*columns), "forest-rows")
            fitted = in_threads(spark, PARALLEL_TREES, fit_tree, [(number,) for number in trees])
        model = self._copyValues(joined_forest(spark, fitted, self.uid))
        model._transfer_params_to_java()  # what the model says of itself comes from there
        return model


class SharedBoosting(GBTClassifier):
    """Spark's gradient-boosted trees, grown over staged blocks of binned rows and their margins.

    The learner of Spark holds every row as an object per fit, in partitions as large as the splits of its input; a task then reads what becomes of a whole
    split. Here a pass reads blocks of a bounded size from flat files (:mod:`propensity.plans.shared_boosting`). Trees, weights of trees and model are Spark's.
    With features that are not binned, sampled rows or features, a validation column, or nodes beyond ``maxMemoryInMB``, Spark's learner does the work.
    """

    #: bins and trees, where they were grown with those of other learners
    grown: tuple[Bins, list[list[Tree]]] | None = None

    def areas_together(self, dataset: DataFrame, held_out: DataFrame, params: list[dict], sizes: list[list[int]]) -> list[list[float]]:
        """Fits for several choices of parameters, and for each the areas of held-out rows after so many trees.

        Fits that read the same columns share staged rows and passes, and held-out rows are read once for them. Each is as it would be alone.
        """
        learners = [self.copy(own) for own in params]
        alike: dict[tuple, list[int]] = {}
        for i, learner in enumerate(learners):
            alike.setdefault(learner._reads(), []).append(i)
        areas: dict[int, list[float]] = {}
        for numbers in alike.values():
            bins, grown = _grown(dataset, [learners[i] for i in numbers])
            shared = {i: trees for i, trees in zip(numbers, grown) if trees is not None}
            for i, trees in shared.items():
                learners[i].grown = bins, [trees]
            models = {i: learners[i]._fit(dataset) for i in numbers}
            if shared:
                runs = [Scored(trees, learners[i].getMaxDepth(), list(models[i].treeWeights), sizes[i]) for i, trees in shared.items()]
                with scratch(dataset.sparkSession):  # ranges of scores are found in one pass over them and taken in another
                    scores = stage(scored(held_out, bins, self.getFeaturesCol(), self.getLabelCol(), runs), "scores")
                    found = iter(_complete(curve_areas(scores), sum(len(sizes[i]) for i in shared)))
                areas |= {i: [next(found) for _ in sizes[i]] for i in shared}
            for i in numbers:
                if i not in shared:
                    areas[i] = prefix_areas(models[i], held_out, sizes[i], self.getLabelCol())
        return [areas[i] for i in range(len(learners))]

    def _reads(self) -> tuple:
        weight = self.getWeightCol() if self.isDefined("weightCol") else None
        return self.getFeaturesCol(), self.getLabelCol(), weight or None, self.getMaxBins()

    def _fit_java(self, dataset: DataFrame):
        bins, (trees,) = self.grown or _grown(dataset, [self])
        if trees is None:
            return super()._fit_java(dataset)
        spark = dataset.sparkSession
        gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
        weights = gateway.new_array(jvm.double, len(trees))
        for i in range(len(trees)):
            weights[i] = self.getStepSize() if i else 1.0
        made = java_trees(spark, trees, bins, rules_of(self, exact=False))
        return jvm.org.apache.spark.ml.classification.GBTClassificationModel(self.uid, made, weights, len(bins.arities), 2)


def _grown(dataset: DataFrame, learners: list[SharedBoosting]) -> tuple[Bins | None, list[list[Tree] | None]]:
    """Trees of learners that read the same columns, ``None`` for those that are Spark's to fit."""
    spark = dataset.sparkSession
    features, label, weight, most = learners[0]._reads()
    bins = bins_of(dataset, features, most)

    def shared(one: SharedBoosting) -> bool:
        plain = one.getSubsamplingRate() == 1.0 and one.getFeatureSubsetStrategy() == "all" and not one.isDefined("validationIndicatorCol")
        return plain and fits(one, bins, len(bins.arities) if bins else 0, exact=False)

    asked = [Fit(rules_of(one, exact=False), one.getMaxIter(), one.getStepSize()) if shared(one) else None for one in learners]
    if not any(asked):
        return bins, [None] * len(learners)
    with scratch(spark):
        pieces = stage_pieces(dataset, bins, features, label, F.col(weight) if weight else F.lit(1.0))
        grown = iter(boost(spark, pieces, bins, [fit for fit in asked if fit]))
    return bins, [next(grown) if fit else None for fit in asked]


def joined_forest(spark: SparkSession, forests: list[RandomForestClassificationModel], uid: str) -> RandomForestClassificationModel:
    """One forest of the trees of several, in order."""
    gateway, classes = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.spark.ml.classification
    trees = [tree for forest in forests for tree in forest._java_obj.trees()]
    array = gateway.new_array(classes.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    first = forests[0]._java_obj
    return RandomForestClassificationModel(classes.RandomForestClassificationModel(uid, array, first.numFeatures(), first.numClasses()))


def leaf_values(model: Model) -> list[list[float]]:
    """What each leaf of each tree adds to the score of the positive class, in the order in which the model numbers leaves."""
    boosted = isinstance(model, GBTClassificationModel)

    def walk(node) -> Iterator[float]:
        if node.getClass().getSimpleName() == "InternalNode":
            yield from walk(node.leftChild())
            yield from walk(node.rightChild())
        elif boosted:
            yield node.prediction()
        else:
            stats = list(node.impurityStats().stats())
            yield stats[1] / sum(stats)

    trees = [list(walk(tree.rootNode())) for tree in model._java_obj.trees()]
    return [[weight * value for value in tree] for weight, tree in zip(model.treeWeights, trees)]


def prefix_areas(model: Model, rows: DataFrame, sizes: list[int], label: str) -> list[float]:
    """Exact area under ROC of the ensembles that end after ``sizes`` trees, from one scoring of the rows.

    A larger ensemble holds each smaller one of the same settings, so one fit and one pass serve them all: a row's leaves are looked up
    once, and running sums of their values are the scores.
    """
    values = leaf_values(model)
    if max(sizes) > len(values):
        raise ValueError(f"the model has {len(values)} trees, asked for {max(sizes)}")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(int)
                sums = np.stack([np.array(own)[leaves[:, i]] for i, own in enumerate(values)], axis=1).cumsum(axis=1)
                positive = (batch.column(1).to_numpy() == 1).astype(np.float64)
                yield counts_batch([collapsed(i, sums[:, size - 1], positive) for i, size in enumerate(sizes)])

    scored = model.copy().setLeafCol("__leaf").transform(rows)
    leaves = scored.select(vector_to_array("__leaf").alias("leaf"), F.col(label).cast("double").alias("label"))
    return _complete(curve_areas(leaves.mapInArrow(score, COUNTS)), len(sizes))


def _complete(found: DataFrame, curves: int) -> list[float]:
    areas = {row["curve"]: row["auc"] for row in found.collect()}
    if len(areas) < curves or None in areas.values():
        raise ValueError("a fold has rows of one class only")
    return [areas[i] for i in range(curves)]
