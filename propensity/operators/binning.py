"""Bins of numeric features, fixed before a tree learner sees them."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.feature import Bucketizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 32
#: a bin holds at least this share of the rows, so that no learner's sample of split candidates misses it
LEAST_SHARE = 1 / 2000
#: cells per doubling of the value, a power of two: quantiles are exact to 1/256 of their size
CELLS = 256


def cell_floor(value: Column) -> Column:
    """Lower end of the cell that holds a finite number: the number with its first 9 binary digits."""
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value))) - int(math.log2(CELLS)))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.floor(value / unit) * unit)


def cell_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per ``(feature, cell)``; ``feature`` is the place among ``columns``. One pass, summed up before the shuffle.

    NULL and NaN are in no cell. The cells do not depend on the rows, so counts of parts add up to those of the whole,
    however the rows are laid out.
    """
    pairs = F.array(*(F.struct(F.lit(i).alias("feature"), F.col(name).cast("double").alias("value")) for i, name in enumerate(columns)))
    values = df.select(F.inline(pairs)).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return values.groupBy("feature", cell_floor(F.col("value")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def quantile_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """Inner edges of the bins of each column, rising; a value belongs to the bin that begins at the last edge not above it.

    An edge is the lower end of a cell at which the rows below pass a multiple of ``1 / bins`` of all. So a column with few
    distinct values has a bin for each, and no more than ``bins`` numbers a column reach the driver. Bins of less than ``LEAST_SHARE`` of the
    rows are joined with the one before. A column without values, or with one, has no edge.
    """
    order = Window.partitionBy("feature").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cell_counts(df, columns).withColumns(
        {"below": F.coalesce(F.sum("n").over(order), F.lit(0).cast("bigint")), "rows": F.sum("n").over(Window.partitionBy("feature"))}
    )
    step = F.floor(F.col("below") * bins / F.col("rows"))
    placed = placed.withColumn("step", step)
    starts = placed.withColumn("before", F.lag("step", 1, -1).over(Window.partitionBy("feature").orderBy("cell"))).filter("step > before")
    edges: list[list[float]] = [[] for _ in columns]
    begun = [0] * len(columns)
    for row in starts.select("feature", "cell", "below", "rows").orderBy("feature", "cell").collect():
        i, least = row["feature"], row["rows"] * LEAST_SHARE
        if row["below"] - begun[i] >= least and row["rows"] - row["below"] >= least and row["below"] > 0:
            edges[i].append(row["cell"])
            begun[i] = row["below"]
    return edges


class QuantileBins(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a ``Bucketizer`` that replaces numbers by the number of their quantile bin.

    Spark's tree learners take split candidates from a sample of rows drawn by partition. On bin numbers there is nothing left to
    choose, so trees do not depend on how the rows were laid out. Rows with NULL or NaN must have been dropped before.
    """

    bins = Param(Params._dummy(), "bins", "largest number of bins of a column", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, bins=BINS):
        super().__init__()
        self._setDefault(bins=BINS)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Bucketizer:
        columns = self.getInputCols()
        edges = quantile_edges(dataset, columns, self.getOrDefault("bins"))
        # a bucketizer needs an edge: without one, all values lie below it
        splits = [[-math.inf, *(own or [1.7976931348623157e308]), math.inf] for own in edges]
        return Bucketizer(splitsArray=splits, inputCols=columns, outputCols=self.getOutputCols(), handleInvalid="keep")
