"""Operators on small hand-made frames."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensity import operators as op
from propensity.functions import cyclical, date_part, days_between, hash_bucket, key_hash, literal_map
from propensity.functions.literals import MAX_LITERAL_KEYS
from propensity.operators.lookup import join_lookup


def column(df, name):
    return [row[name] for row in df.collect()]


# --- cleaning and profiling ------------------------------------------------------------------------------


def test_cast_leaves_64_bit_ids_alone(spark):
    df = spark.createDataFrame([(1, 2, True, "x")], "id bigint, i int, b boolean, s string")
    assert op.columns_of_type(df, T.IntegerType, T.BooleanType) == ["i", "b"]
    assert op.cast_to_double(df).dtypes == [("id", "bigint"), ("i", "double"), ("b", "double"), ("s", "string")]


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, None)], "`Date.diff` int, `a.b` int")
    assert op.rename_columns(df, {"Date.diff": "date_diff"}).columns == ["date_diff", "a.b"]
    assert op.cast_to_double(df).columns == ["Date.diff", "a.b"]
    assert [tuple(row) for row in op.missing_report(df).collect()] == [("a.b", 1), ("Date.diff", 0)]


def test_missing_report_of_an_empty_frame(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert [tuple(row) for row in op.missing_report(empty).collect()] == [("a", 0), ("b", 0)]


def test_missing_report_needs_one_exchange(spark, tables):
    report = op.missing_report(spark.read.parquet(f"{tables}/orders.parquet"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_sparse_rows_at_the_limit(spark):
    rows = [tuple([1] * (10 - nulls) + [None] * nulls) for nulls in range(11)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(10)))
    assert op.drop_sparse_rows(df, 80).count() == 9


def test_nan_counts_as_empty_on_request_only(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (2.0, float("nan"))], "a double, b double")
    assert op.drop_sparse_rows(df, 40).count() == 2
    assert op.drop_sparse_rows(df, 40, nan_is_null=True).count() == 0
    assert op.drop_sparse_columns(df, 80).columns == ["a", "b"]
    assert op.drop_sparse_columns(df, 80, nan_is_null=True).columns == ["a"]


def test_sparse_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None), (3, 1, None)], "a int, b int, c int")
    assert op.drop_sparse_columns(df, 80).columns == ["a", "b"]
    assert op.drop_sparse_columns(df, 50).columns == ["a"]
    assert op.drop_sparse_columns(df.limit(0), 80).columns == ["a", "b", "c"]


def test_invalid_rows_are_null_or_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, math.nan)], "k int, x double")
    assert column(op.skip_invalid_rows(df, ["x"]), "k") == [1]


# --- splits ----------------------------------------------------------------------------------------------


def test_split_does_not_depend_on_layout(spark):
    df = spark.range(2000).toDF("k")
    one = op.with_split(df.repartition(1), "k")
    seven = op.with_split(df.repartition(7), "k")
    assert one.exceptAll(seven).isEmpty() and seven.exceptAll(one).isEmpty()


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=20))
def test_key_hash_is_exact_for_any_64_bit_key(spark, keys):
    df = spark.createDataFrame([(key,) for key in keys], "k bigint").select("k", key_hash(F.col("k")).alias("h"))
    for row in df.collect():
        assert row["h"] == (row["k"] * 1103515245 + 12345) % 2147483647


def test_rows_without_key_stay_in_one_side(spark):
    df = spark.createDataFrame([(1,), (None,)], "k bigint")
    train, test = op.train_test_split(df, "k")
    assert train.count() + test.count() == 2


def test_train_share_and_folds(spark):
    df = spark.range(20000).toDF("k")
    share = op.with_split(df, "k").filter("split = 'train'").count() / 20000
    assert abs(share - 0.8) < 0.01
    sizes = [row["count"] for row in op.with_fold(df, "k", 3).groupBy("fold").count().collect()]
    assert len(sizes) == 3 and max(sizes) - min(sizes) < 1000
    assert df.select(F.min(hash_bucket(F.col("k"))), F.max(hash_bucket(F.col("k")))).first() == (0, 99)


@pytest.mark.parametrize("folds", [3, 50, 100])
def test_folds_are_independent_of_the_split(spark, folds):
    train, _ = op.train_test_split(spark.range(100_000).toDF("k"), "k")
    sizes = {row["fold"]: row["count"] for row in op.with_fold(train, "k", folds).groupBy("fold").count().collect()}
    expected = sum(sizes.values()) / folds
    assert set(sizes) == set(range(folds))
    assert max(abs(size - expected) for size in sizes.values()) < 5 * expected**0.5


def test_random_split_covers_the_input(spark):
    train, test = op.random_split(spark.range(1000).toDF("k"))
    assert train.count() + test.count() == 1000


# --- expressions -----------------------------------------------------------------------------------------


def test_leap_day_and_week(spark):
    df = spark.sql("SELECT date '2016-12-31' AS d, date '2017-01-01' AS e")
    row = df.select(
        date_part("dayofyear", F.col("d")).alias("day"),
        date_part("dayofweek", F.col("e")).alias("week"),
        days_between(F.col("d"), F.col("e")).alias("days"),
        cyclical("dayofyear", F.col("d"))[0].alias("sine"),
    ).first()
    assert (row["day"], row["week"], row["days"]) == (366, 1, 1)
    assert round(row["sine"], 4) == 0.0172


def test_cyclical_pairs_lie_on_the_unit_circle(spark):
    df = spark.range(800).select(F.expr("date_add(date '2015-06-01', cast(id as int))").alias("d"))
    encoder = op.CyclicalDateTransformer(inputCols=["d"], parts=["month", "dayofyear", "dayofweek"])
    encoded = encoder.transform(df)
    assert encoded.columns == encoder.output_columns()
    for part in ("month", "dayofyear", "dayofweek"):
        radius = F.pow(f"d_{part}_sin", F.lit(2)) + F.pow(f"d_{part}_cos", F.lit(2))
        assert encoded.filter(F.abs(radius - 1) > 1e-12).isEmpty()


def test_cyclical_rejects_unknown_parts(spark):
    with pytest.raises(ValueError):
        op.CyclicalDateTransformer(inputCols=["d"], parts=["hour"]).output_columns()


def test_literal_map_misses_and_limit(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    assert column(df.select(literal_map({"a": 1.5}, F.col("k")).alias("v")), "v") == [1.5, None, None]
    with pytest.raises(ValueError):
        literal_map({i: i for i in range(MAX_LITERAL_KEYS + 1)}, F.col("k"))


# --- lookup join -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [10**9, 0], ids=["broadcast", "hot keys apart"])
def test_lookup_join_keeps_every_row_once(spark, limit):
    # key 0 holds a third of the rows, another third has no key, the rest is spread over 400 keys
    rows = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") < 1000, 0).when(F.col("id") >= 2000, 1 + F.col("id") % 400).cast("string").alias("key"),
    )
    counts = rows.filter("key is not null and key <> '7'").groupBy("key").agg(F.count("*").alias("n"))
    lookup = counts.select("key", "n", (F.col("key").cast("int") * 2).alias("value"))
    joined = join_lookup(
        rows, lookup, ["key"], lookup_bytes=1, rows_column="n", total_rows=2000, max_broadcast_bytes=limit
    )
    assert joined.columns == ["id", "key", "value"]
    got = {row["id"]: row for row in joined.collect()}
    assert len(got) == joined.count() == 3000
    for row in got.values():
        known = row["key"] is not None and row["key"] != "7"
        assert row["value"] == (2 * int(row["key"]) if known else None)


def test_large_lookup_shuffles_no_hot_rows(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("key"))
    lookup = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("value", F.lit(1))
    joined = join_lookup(
        rows, lookup, ["key"], lookup_bytes=1, rows_column="n", total_rows=1000, max_broadcast_bytes=0
    )
    hot = lookup.filter(F.col("n") * 200 > 1000)
    assert hot.count() == 1
    logical = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in logical and logical.count("strategy=broadcast") == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # the hot key's rows are settled and dealt out by their salt
        sizes = [row["count"] for row in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 8 and max(sizes) < 250


# --- weights ---------------------------------------------------------------------------------------------


def test_weights(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (0.0,)], "y double")
    assert sorted(column(op.with_class_weights(df, "y"), "weight_col")) == [0.2, 0.2, 0.2, 0.8]
    balanced = op.with_balanced_weights(df.unionByName(spark.createDataFrame([(None,)], "y double")), "y")
    sums = {row["y"]: row["w"] for row in balanced.groupBy("y").agg(F.sum("weight_col").alias("w")).collect()}
    assert sums == {0.0: pytest.approx(2.0), 1.0: pytest.approx(2.0)}
