"""Metrics against Spark's evaluators and brute force."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from propensity.operators import area_under_roc, confusion_matrix, per_class_metrics, weighted_metrics


def frame(spark, rows):
    return spark.createDataFrame(rows, "label double, prediction double, score double")


def random_rows(n, seed, levels):
    source = random.Random(seed)
    rows = []
    for _ in range(n):
        label = float(source.random() < 0.7)
        score = source.randrange(levels) / levels + 0.1 * label
        rows.append((label, float(score > 0.4), score))
    return rows


@pytest.mark.parametrize("levels", [5, 100000], ids=["ties", "distinct"])
def test_area_under_roc_by_brute_force(spark, levels):
    rows = random_rows(400, 1, levels)
    positives = [score for label, _, score in rows if label == 1]
    negatives = [score for label, _, score in rows if label == 0]
    won = sum((p > n) + (p == n) / 2 for p in positives for n in negatives)
    df = frame(spark, rows)
    got = area_under_roc(df, "label", "score").first()
    assert (got["positives"], got["negatives"]) == (len(positives), len(negatives))
    assert got["auc"] == pytest.approx(won / len(positives) / len(negatives), abs=1e-12)
    builtin = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert got["auc"] == pytest.approx(builtin, abs=1e-9)


def test_area_does_not_depend_on_layout(spark):
    df = frame(spark, random_rows(1000, 2, 300))
    areas = {area_under_roc(df.repartition(n), "label", "score").first()["auc"] for n in (1, 7)}
    assert len(areas) == 1


def test_area_with_a_hot_score(spark):
    rows = random_rows(300, 3, 1000) + [(1.0, 1.0, 0.5)] * 100 + [(0.0, 1.0, 0.5)] * 50
    df = frame(spark, rows)
    counted = df.groupBy("label", "score").agg(F.count("*").alias("n"))
    assert (
        area_under_roc(df, "label", "score").first() == area_under_roc(counted, "label", "score", count="n").first()
    )


def test_area_without_one_class_is_null(spark):
    df = frame(spark, [(1.0, 1.0, 0.3), (1.0, 0.0, 0.4)])
    assert tuple(area_under_roc(df, "label", "score").first()) == (2, 0, None)
    assert tuple(area_under_roc(df.limit(0), "label", "score").first()) == (0, 0, None)


def test_weighted_metrics_equal_the_evaluator(spark):
    df = frame(spark, random_rows(500, 4, 50))
    got = weighted_metrics(confusion_matrix(df)).first()
    names = {
        "accuracy": "accuracy",
        "f1": "f1",
        "weighted_precision": "weightedPrecision",
        "weighted_recall": "weightedRecall",
    }
    for ours, theirs in names.items():
        assert got[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(df), abs=1e-12)
    negative = MulticlassClassificationEvaluator(metricName="recallByLabel", metricLabel=0.0).evaluate(df)
    assert got["recall_negative"] == pytest.approx(negative, abs=1e-12)
    assert got["weighted_recall"] == pytest.approx(got["accuracy"], abs=1e-12)
    assert got["recall_negative"] != pytest.approx(got["accuracy"], abs=1e-3)


def test_class_that_is_never_predicted(spark):
    df = frame(spark, [(1.0, 1.0, 0.9), (0.0, 1.0, 0.8)])
    rows = {row["class"]: row for row in per_class_metrics(confusion_matrix(df)).collect()}
    assert (rows[0.0]["support"], rows[0.0]["precision"], rows[0.0]["f1"]) == (1, 0.0, 0.0)
    assert rows[1.0]["precision"] == 0.5


def test_unknown_metric_names_are_rejected(spark):
    df = frame(spark, [(1.0, 1.0, 0.9)])
    with pytest.raises(Exception):
        MulticlassClassificationEvaluator(metricName="support").evaluate(df)
