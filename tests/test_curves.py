"""Areas under many curves at once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from propensity.operators import area_under_roc, curve_areas
from propensity.operators.curves import _sums, _won, collapsed, counts_batch

SCHEMA = "curve int, score double, pos bigint, neg bigint"


@pytest.fixture
def many_parts(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def areas(df):
    return {r["curve"]: (r["positives"], r["negatives"], r["auc"]) for r in curve_areas(df).collect()}


def test_equals_the_area_of_each_curve(spark, many_parts):
    source = random.Random(1)
    rows = [(c, float(source.randrange(30)), source.randrange(3), source.randrange(4)) for c in (-2, 0, 7) for _ in range(300)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = areas(table)
    for curve in (-2, 0, 7):
        one = table.filter(F.col("curve") == curve)
        labelled = one.selectExpr("score", "1 as y", "pos as n").union(one.selectExpr("score", "0", "neg"))
        expected = area_under_roc(labelled, "y", "score", count="n").first()
        assert found[curve] == (expected["positives"], expected["negatives"], pytest.approx(expected["auc"], abs=1e-14))


def test_layout_and_pieces_change_nothing(spark):
    source = random.Random(2)
    rows = [(0, source.choice([0.25, 0.5, -0.0, 0.0, source.random()]), source.randrange(2), 1) for _ in range(2000)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert len({areas(table.repartition(n))[0] for n in (1, 3, 16)}) == 1
    assert areas(table)[0] == areas(table.groupBy("curve", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))[0]


def test_one_class_and_missing_scores(spark):
    assert areas(spark.createDataFrame([(1, 0.5, 3, 0), (2, 0.5, 2, 2)], SCHEMA)) == {1: (3, 0, None), 2: (2, 2, 0.5)}
    assert areas(spark.createDataFrame([], SCHEMA)) == {}
    for bad in (None, float("nan")):
        with pytest.raises(Exception, match="a score is missing"):
            areas(spark.createDataFrame([(1, bad, 1, 1)], SCHEMA))


def test_tasks_follow_the_rows_not_a_constant(spark, many_parts):
    partitions = "spark.sql.shuffle.partitions"
    table = spark.range(20_000).selectExpr("cast(id % 3 as int) as curve", "rand(5) as score", "id % 2 as pos", "1 - id % 2 as neg")
    given = spark.conf.get(partitions)
    found = []
    try:
        for number in (2, 200):
            spark.conf.set(partitions, str(number))
            ordered = table.repartitionByRange("curve", "score")
            assert ordered.rdd.getNumPartitions() == number
            found.append(areas(table))
    finally:
        spark.conf.set(partitions, given)
    assert found[0] == found[1]


def test_runs_go_on_across_batches_and_products_stay_exact():
    counts = [(0, 1.0, 1, 2), (0, 1.0, 3, 0), (0, 2.0, 1, 1), (1, 0.0, 2, 5), (1, 0.0, 0, 1), (1, 9.0, 1, 0)]
    for cut in range(1, 6):
        batches = [
            counts_batch([tuple(np.array([c], k) for c, k in zip(row, (np.int32, float, np.int64, np.int64)))])
            for row in counts
        ]
        grouped = [b for b in batches[:cut]], [b for b in batches[cut:]]
        rows = list(_sums(iter([*grouped[0], *grouped[1]]), 4))
        # positives times twice the negatives below plus those tied
        assert rows == [(4, 0, 5, 3, 4 * 2 + 1 * (2 * 2 + 1)), (4, 1, 3, 6, 2 * 6 + 1 * 12)]
    large = np.array([1 << 40, 3], np.int64)
    assert _won(large, large) == (1 << 80) + 9


def test_collapsing_keeps_the_counts():
    curve, score, pos, neg = collapsed(5, np.array([2.0, 1.0, 2.0, 2.0]), np.array([1.0, 0.0, 0.0, 1.0]))
    assert (curve.tolist(), score.tolist(), pos.tolist(), neg.tolist()) == ([5, 5], [1.0, 2.0], [0, 2], [1, 1])
