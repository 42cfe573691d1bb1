"""Splits of staged tables for learners."""

from pyspark.sql import functions as F

from propensity import session
from propensity.session import small_splits
from propensity.sources import stage_spread


def test_a_learners_task_reads_a_bounded_part_of_a_staged_table(spark, monkeypatch):
    monkeypatch.setattr(session, "SPLIT_BYTES", 1 << 20)
    monkeypatch.setattr("propensity.sources.tables.ROW_GROUP_BYTES", 1 << 19)
    rows = spark.range(0, 3_200_000, numPartitions=8).select("id", F.hash("id").alias("x"), F.rand(1).alias("y"))
    staged = stage_spread(rows, "splits")
    given = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with small_splits(spark):
        parts = staged.select("*")
        sizes = [row["count"] for row in parts.groupBy(F.spark_partition_id()).count().collect()]
        assert parts.rdd.getNumPartitions() >= 32
    assert max(sizes) <= 300_000 and sum(sizes) == 3_200_000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == given
