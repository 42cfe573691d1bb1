"""Catalog tables and the staged train/test table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.operators.splitting import with_split
from propensity.session import ROW_GROUP_BYTES, scratch_path


def write_table(
    df: DataFrame,
    name: str,
    partition_by: list[str] | None = None,
    path: str | None = None,
    file_format: str = "parquet",
    mode: str = "overwrite",
) -> None:
    """Save ``df`` as the catalog table ``name``; below ``path`` if given, else in the warehouse.

    ``file_format="delta"`` works where the session has that format on its class path.
    """
    writer = df.write.format(file_format).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Scan a catalog table."""
    return spark.read.table(name)


def stage(df: DataFrame, name: str, partition_by: str | None = None, compression: str | None = None, row_group: int | None = None) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and scan it: the lineage ends there, and outlives executors."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("parquet.block.size", row_group) if row_group else df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_spread(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """:func:`stage` for rows that cost far more than their bytes, such as those of a learner: one split per core at least.

    A large table has more splits than cores as it is. A small one would be read by one task; it is dealt anew. Row groups are small, so
    that a learner's task may read little (:func:`propensity.session.small_splits`).
    """
    staged = stage(df, name, partition_by, row_group=ROW_GROUP_BYTES)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return staged if staged.rdd.getNumPartitions() >= cores else stage(staged.repartition(cores), name, partition_by, row_group=ROW_GROUP_BYTES)


def stage_split(
    df: DataFrame, key: str, train_percent: int = 80, columns: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split by ``key``, write once, and return scans of the train and the test side.

    Fitting passes over its input many times. The written table cuts the lineage, lets each pass read only
    the columns it needs, and outlives lost executors; the two sides are partitions of it, so each scan
    reads its own files only. ``columns`` limits what is written; the key always is.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "split")
    if columns is not None:
        df = df.select(*dict.fromkeys([key, *columns]))
    writer = with_split(df, key, train_percent).drop("bucket").write.option("parquet.block.size", ROW_GROUP_BYTES)
    writer.partitionBy("split").parquet(path)
    staged = spark.read.parquet(path)
    return (
        staged.filter(F.col("split") == "train").drop("split"),
        staged.filter(F.col("split") == "test").drop("split"),
    )
