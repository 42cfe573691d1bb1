"""Index of categories by frequency, for columns with any number of values."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasHandleInvalid, HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propensity.operators.lookup import MAX_BROADCAST_BYTES, join_lookup
from propensity.session import scratch_path

# Bytes of a lookup row next to its category text: count, index and row overhead.
ROW_BYTES = 48
INVALID = ("error", "skip", "keep")


def frequency_ranks(counts: DataFrame) -> DataFrame:
    """``counts`` (``category``, ``n``) with ``rank``: 0 for the most frequent category, ties by the category itself.

    The categories are range-partitioned in that order and numbered range by range; one row per range tells how many come before. So no task
    sees all categories, and nothing goes to the driver.
    """
    order = [F.col("n").desc(), F.col("category").asc()]
    spark = counts.sparkSession
    path = scratch_path(spark, "ranked-categories")
    counts.repartitionByRange(*order).withColumn("range_id", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("range_id").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("range_id", F.coalesce(F.sum("size").over(earlier), F.lit(0).cast("bigint")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range_id").orderBy(*order))
    placed = ranged.withColumn("place", place).join(F.broadcast(before), "range_id")  # a row per written range
    return placed.select("category", "n", (F.col("before") + F.col("place") - 1).alias("rank"))


class _IndexerParams(HasInputCol, HasOutputCol, HasHandleInvalid):
    maxBroadcastBytes = Param(
        Params._dummy(), "maxBroadcastBytes", "size up to which the lookup is broadcast", typeConverter=TypeConverters.toInt
    )

    def __init__(self):
        super().__init__()
        self._setDefault(handleInvalid="error", maxBroadcastBytes=MAX_BROADCAST_BYTES)


class FrequencyIndexer(Estimator, _IndexerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Spark's string indexer (most frequent first, ties in alphabetical order) without labels on the driver.

    Fitting counts the values and ranks them as a distributed table in the shared folder; only totals come to the driver. NULL is
    no category.
    """

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, handleInvalid=None, maxBroadcastBytes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FrequencyIndexerModel:
        if self.getHandleInvalid() not in INVALID:
            raise ValueError(f"handleInvalid is one of {INVALID}")
        spark = dataset.sparkSession
        values = dataset.select(F.col(self.getInputCol()).cast("string").alias("category")).filter("category is not null")
        path = scratch_path(spark, "category-ranks")
        frequency_ranks(values.groupBy("category").agg(F.count(F.lit(1)).alias("n"))).write.parquet(path)
        ranks = spark.read.parquet(path)
        size = F.sum(F.octet_length("category") + ROW_BYTES)
        total = ranks.agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows"), size.alias("bytes")).first()
        model = FrequencyIndexerModel(ranks, total["labels"], total["rows"] or 0, total["bytes"] or 0)
        return self._copyValues(model)


class FrequencyIndexerModel(Model, _IndexerParams, MLReadable, MLWritable):
    """Adds the index of a category as a double.

    NULL and unseen categories: rows dropped (``skip``), indexed as the number of categories (``keep``), or an error (``error``).
    """

    def __init__(self, ranks: DataFrame, labels: int, rows: int, lookup_bytes: int):
        super().__init__()
        self.ranks, self.labels, self.rows, self.lookup_bytes = ranks, labels, rows, lookup_bytes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column, output, invalid = self.getInputCol(), self.getOutputCol(), self.getHandleInvalid()
        key = f"__{output}_key"
        lookup = self.ranks.select(F.col("category").alias(key), F.col("n").alias("__rows"), F.col("rank").cast("double").alias(output))
        joined = join_lookup(
            dataset.withColumn(key, F.col(column).cast("string")),
            lookup,
            [key],
            lookup_bytes=self.lookup_bytes,
            rows_column="__rows",
            total_rows=self.rows,
            max_broadcast_bytes=self.getOrDefault("maxBroadcastBytes"),
        ).drop(key)
        if invalid == "skip":
            return joined.filter(F.col(output).isNotNull())
        missing = F.lit(float(self.labels)) if invalid == "keep" else F.raise_error(F.lit(f"a value of {column} is NULL or unseen"))
        return joined.withColumn(output, F.coalesce(F.col(output), missing))

    def write(self) -> MLWriter:
        return _IndexerWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _IndexerReader(cls)


class _IndexerWriter(MLWriter):
    def __init__(self, instance: FrequencyIndexerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        model = self.instance
        sizes = {"labels": model.labels, "rows": model.rows, "lookupBytes": model.lookup_bytes}
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession, extraMetadata=sizes)
        model.ranks.write.parquet(f"{path}/ranks")


class _IndexerReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FrequencyIndexerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        ranks = self.sparkSession.read.parquet(f"{path}/ranks")
        model = self.cls(ranks, metadata["labels"], metadata["rows"], metadata["lookupBytes"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
