"""The distributed string indexer against Spark's own."""

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from propensity.operators import FrequencyIndexer, FrequencyIndexerModel, map_values
from propensity.session import scratch_path
from propensity.sources import read_scores, write_scores


@pytest.fixture
def rows(spark):
    # frequencies with many ties, NULLs, and texts that sort by bytes
    return spark.range(5000).select(
        "id", F.when(F.col("id") % 11 > 0, F.concat(F.lit("é" * 2), F.pmod(F.hash("id"), F.lit(700)).cast("string"))).alias("name")
    )


def indexed(model, rows):
    return dict(map(tuple, model.transform(rows).select("id", "i").collect()))


@pytest.mark.parametrize("limit", [1, 1 << 26], ids=["joined", "broadcast"])
def test_indices_are_those_of_the_learner(rows, limit):
    ours = FrequencyIndexer(inputCol="name", outputCol="i", handleInvalid="skip", maxBroadcastBytes=limit).fit(rows)
    theirs = StringIndexer(inputCol="name", outputCol="i", handleInvalid="skip").fit(rows)
    assert ours.labels == len(theirs.labels)
    assert indexed(ours, rows) == indexed(theirs, rows)
    assert ours.transform(rows).columns == ["id", "name", "i"]


def test_unseen_and_missing_values(spark, rows):
    new = spark.createDataFrame([(1, None), (2, "unseen"), (3, "éé1")], "id bigint, name string")
    keep = FrequencyIndexer(inputCol="name", outputCol="i", handleInvalid="keep").fit(rows)
    found = indexed(keep, new)
    assert found[1] == found[2] == keep.labels and found[3] < keep.labels
    with pytest.raises(Exception, match="NULL or unseen"):
        FrequencyIndexer(inputCol="name", outputCol="i").fit(rows).transform(new).collect()
    with pytest.raises(ValueError, match="handleInvalid"):
        FrequencyIndexer(inputCol="name", outputCol="i", handleInvalid="drop").fit(rows)


def test_saved_and_loaded(spark, rows):
    model = FrequencyIndexer(inputCol="name", outputCol="i", handleInvalid="skip").fit(rows)
    path = scratch_path(spark, "indexer")
    model.write().save(path)
    loaded = FrequencyIndexerModel.load(path)
    assert indexed(loaded, rows) == indexed(model, rows) and loaded.labels == model.labels


def test_numbers_and_empty_tables(spark):
    numbers = spark.createDataFrame([(1, 7), (2, 7), (3, 5)], "id bigint, name int")
    assert indexed(FrequencyIndexer(inputCol="name", outputCol="i").fit(numbers), numbers) == {1: 0.0, 2: 0.0, 3: 1.0}
    empty = FrequencyIndexer(inputCol="name", outputCol="i", handleInvalid="keep").fit(numbers.limit(0))
    assert indexed(empty, numbers) == {1: 0.0, 2: 0.0, 3: 0.0}


def test_mappings_of_any_size(spark):
    table = spark.createDataFrame([(1, "k5"), (2, "k4999"), (3, "none"), (4, None)], "id bigint, k string")
    for size in (10, 6000):
        found = map_values(table, {f"k{i}": float(i) for i in range(size)}, "k", "v").collect()
        assert {r["id"]: r["v"] for r in found} == {1: 5.0, 2: 4999.0 if size > 10 else None, 3: None, 4: None}
        assert found[0].asDict().keys() == {"id", "k", "v"}


def test_a_repeated_run_leaves_the_same_scores(spark):
    path = scratch_path(spark, "scores-test")
    rows = spark.range(100).selectExpr("id", "id / 100 as score", "cast(id % 5 as int) as part")
    write_scores(rows, path, "m1", "part")
    before = sorted(map(tuple, read_scores(spark, path).collect()))
    write_scores(rows, path, "m1", "part")
    write_scores(rows.filter("part = 2"), path, "m1", "part")
    write_scores(rows.limit(0), path, "m1", "part")
    assert sorted(map(tuple, read_scores(spark, path).collect())) == before
    write_scores(rows.filter("part = 2").withColumn("score", F.lit(0.5)), path, "m2", "part")
    found = read_scores(spark, path)
    assert found.filter("model = 'm1'").count() == 100 and found.filter("model = 'm2'").count() == 20
