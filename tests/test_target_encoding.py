"""Target encoding against hand-computed values and the built-in encoder."""

import pytest
from pyspark.ml.feature import StringIndexer, TargetEncoder
from pyspark.sql import functions as F

from propensity.operators import AutoTargetEncoder, AutoTargetEncoderModel, out_of_fold_encode, with_fold
from propensity.session import scratch_path

ROWS = [("a", 1.0), ("a", 1.0), ("a", 0.0), ("b", 0.0), ("b", 0.0), ("c", 1.0), (None, 1.0)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, "c string, y double")


def encoder(**options):
    return AutoTargetEncoder(inputCol="c", outputCol="te", labelCol="y", **options)


def encoded(model, df):
    return {row["c"]: row["te"] for row in model.transform(df).collect()}


def test_auto_smoothing_by_hand(spark, small):
    unseen = spark.createDataFrame([("new", None)], "c string, y double")
    values = encoded(encoder().fit(small), small.unionByName(unseen))
    share = 4 / 7
    prior, n, mean, variance = share * (1 - share), 3, 2 / 3, 2 / 9
    weight = prior * n / (prior * n + variance)
    assert values["a"] == pytest.approx(weight * mean + (1 - weight) * share)
    assert values["b"] == 0.0 and values["c"] == 1.0  # no spread within: their own mean
    assert values[None] == values["new"] == pytest.approx(share)


def test_single_class_gives_the_overall_share(small):
    ones = small.filter("y = 1")
    assert set(encoded(encoder().fit(ones), ones).values()) == {1.0}


def test_fixed_smoothing_equals_the_builtin(spark, small):
    known = small.dropna()
    indexed = StringIndexer(inputCol="c", outputCol="i").fit(known).transform(known)
    builtin = TargetEncoder(
        inputCols=["i"], outputCols=["te"], labelCol="y", targetType="binary", smoothing=3.0, handleInvalid="keep"
    ).fit(indexed)
    expected = {row["c"]: row["te"] for row in builtin.transform(indexed).collect()}
    assert encoded(encoder(smoothing=3).fit(known), known) == pytest.approx(expected)


def test_rows_without_label_are_ignored_and_others_checked(spark, small):
    unlabelled = small.unionByName(spark.createDataFrame([("a", None)] * 5, "c string, y double"))
    assert encoded(encoder().fit(unlabelled), small) == encoded(encoder().fit(small), small)
    with pytest.raises(ValueError, match="neither 0 nor 1"):
        encoder().fit(small.withColumn("y", F.col("y") * 2))
    with pytest.raises(ValueError, match="no row"):
        encoder().fit(small.filter("false"))
    with pytest.raises(ValueError):
        encoder(smoothing=0)


@pytest.mark.parametrize("smoothing", ["auto", 5.0])
def test_large_lookup_gives_the_same_rows(spark, smoothing):
    df = with_fold(
        spark.range(5000).select(
            "id",
            F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("c"), F.col("id") % 900))
            .alias("c"),
            (F.col("id") % 7 < 4).cast("double").alias("y"),
        ),
        "id",
    )
    small_way = encoder(smoothing=smoothing).fit(df).transform(df)
    large_way = encoder(smoothing=smoothing, maxBroadcastBytes=0).fit(df).transform(df)
    assert small_way.columns == large_way.columns
    assert small_way.exceptAll(large_way).isEmpty() and large_way.exceptAll(small_way).isEmpty()
    assert large_way.count() == 5000

    def out_of_fold(limit):
        return out_of_fold_encode(df, "c", "y", "fold", "te", 3, smoothing, max_broadcast_bytes=limit)

    assert out_of_fold(10**9).exceptAll(out_of_fold(0)).isEmpty()
    assert out_of_fold(0).count() == 5000


def test_own_label_does_not_enter_out_of_fold(spark):
    df = with_fold(
        spark.range(300).select(
            "id", F.concat(F.lit("c"), F.col("id") % 5).alias("c"), (F.col("id") % 3 == 0).cast("double").alias("y")
        ),
        "id",
    )
    flipped = df.withColumn("y", F.when(F.col("id") == 17, 1 - F.col("y")).otherwise(F.col("y")))

    def values(frame):
        return {r["id"]: r["te"] for r in out_of_fold_encode(frame, "c", "y", "fold", "te", 3).collect()}

    before, after = values(df), values(flipped)
    assert before[17] == after[17]
    assert before != after


def test_out_of_fold_by_brute_force(spark):
    df = with_fold(
        spark.range(200).select(
            "id",
            F.when(F.col("id") % 11 != 0, F.concat(F.lit("c"), F.col("id") % 6)).alias("c"),
            (F.col("id") * 7 % 10 < 6).cast("double").alias("y"),
        ),
        "id",
    )
    rows = df.collect()
    for got in out_of_fold_encode(df, "c", "y", "fold", "te", 3, smoothing=4).collect():
        others = [r for r in rows if r["fold"] != got["fold"]]
        share = sum(r["y"] for r in others) / len(others)
        same = [r["y"] for r in others if r["c"] == got["c"] and got["c"] is not None]
        assert got["te"] == pytest.approx((sum(same) + 4 * share) / (len(same) + 4))


def test_folds_are_checked(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 0.0, 3)], "c string, y double, fold int")
    with pytest.raises(ValueError, match="integers"):
        out_of_fold_encode(df, "c", "y", "fold", "te", 3)
    with pytest.raises(ValueError, match="two folds"):
        out_of_fold_encode(df.filter("fold = 0"), "c", "y", "fold", "te", 3)


def test_model_survives_saving(spark, small):
    model = encoder(smoothing=2).fit(small)
    path = scratch_path(spark, "te-model")
    model.write().overwrite().save(path)
    loaded = AutoTargetEncoderModel.load(path)
    assert loaded.uid == model.uid
    assert encoded(loaded, small) == encoded(model, small)
    again = AutoTargetEncoder.load(_saved(encoder(smoothing=2), spark))
    assert again.getOrDefault("smoothing") == 2


def _saved(stage, spark):
    path = scratch_path(spark, "te")
    stage.save(path)
    return path
