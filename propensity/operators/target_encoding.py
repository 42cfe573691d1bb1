"""Target encoding of categories, fitted and applied as Spark aggregates and joins.

A category with ``n`` rows, of which a share ``p`` is positive, is encoded as a mixture of ``p`` and the
overall share ``g``:

* ``smoothing="auto"``: the weight of ``p`` is ``v*n / (v*n + p*(1-p))`` with ``v = g*(1-g)``, the
  empirical-Bayes shrinkage of Micci-Barreca (SIGKDD Explorations 3(1), 2001). The encoding is ``g`` where
  that is 0/0.
* ``smoothing=m``: ``(n*p + m*g) / (n + m)``.

NULL and unseen categories are encoded as ``g``. Everything is computed from integer counts, so the result
does not depend on the order or the partitioning of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
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
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from propensity.functions.literals import literal_map
from propensity.operators.lookup import MAX_BROADCAST_BYTES, join_lookup
from propensity.operators.splitting import with_fold
from propensity.session import scratch_path

# Bytes of a lookup row next to its category text: counts, encoding and row overhead.
ROW_BYTES = 64


def category_counts(df: DataFrame, keys: list[str], label: str, count: str | None = None) -> DataFrame:
    """Rows and positives per key, ``(*keys, n, positives, unusable)``, in one partial + final aggregate.

    Rows without a label are left out; ``unusable`` counts labels other than 0 and 1. ``count`` names a column of row counts of
    pre-aggregated input.
    """
    target = F.col(label)
    rows = F.col(count).cast("bigint") if count else F.lit(1).cast("bigint")

    def counted(condition: Column) -> Column:
        return F.sum(F.when(condition, rows).otherwise(0))

    return (
        df.filter(target.isNotNull())
        .groupBy(*keys)
        .agg(
            F.sum(rows).alias("n"),
            counted(target == 1).alias("positives"),
            counted(~target.isin(0, 1)).alias("unusable"),
        )
    )


def smoothed(n: Column, positives: Column, share: Column, smoothing: str | float) -> Column:
    """The encoding of a category from its counts and the overall positive share."""
    if smoothing != "auto":
        return (positives + smoothing * share) / (n + smoothing)
    mean = F.when(n > 0, positives / n)
    prior = share * (1 - share)
    variance = mean * (1 - mean)
    scale = prior * n + variance
    return F.when(scale > 0, (prior * n * mean + variance * share) / scale).otherwise(share)


def checked_smoothing(value):
    """``"auto"`` or a positive number."""
    if value == "auto":
        return value
    number = float(value)
    if number <= 0:
        raise ValueError(f"smoothing is 'auto' or a positive number, got {value!r}")
    return number


class _TargetEncoderParams(HasInputCol, HasOutputCol, HasLabelCol):
    smoothing = Param(
        Params._dummy(), "smoothing", "'auto' or a fixed number of prior rows", typeConverter=checked_smoothing
    )
    maxBroadcastBytes = Param(
        Params._dummy(),
        "maxBroadcastBytes",
        "size up to which the lookup is broadcast",
        typeConverter=TypeConverters.toInt,
    )
    outOfFold = Param(
        Params._dummy(),
        "outOfFold",
        "folds by which training rows are encoded without their own label; 0: like all other rows",
        typeConverter=TypeConverters.toInt,
    )
    countCol = Param(
        Params._dummy(),
        "countCol",
        "column of row counts, where the rows to fit on are counts of rows; empty: they are rows",
        typeConverter=TypeConverters.toString,
    )
    keyCol = Param(
        Params._dummy(), "keyCol", "row key that decides the fold", typeConverter=TypeConverters.toString
    )

    def __init__(self):
        super().__init__()
        self._setDefault(smoothing="auto", maxBroadcastBytes=MAX_BROADCAST_BYTES, outOfFold=0, countCol="")


class AutoTargetEncoder(Estimator, _TargetEncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns one number per category from a 0/1 label.

    Fitting is one aggregate over two columns. Its result, one row per category, is written to the shared
    folder: later transforms read it back instead of aggregating the training rows again. So a fitted model
    lives as long as that table: save it, and load it from there, before the folder is cleaned.

    With ``outOfFold`` folds, :meth:`encode_training` gives the rows that the next stages are to be fitted on: each encoded
    from the other folds only. Fitting and scoring are not affected.
    """

    @keyword_only
    def __init__(
        self,
        *,
        inputCol=None,
        outputCol=None,
        labelCol=None,
        smoothing=None,
        maxBroadcastBytes=None,
        outOfFold=None,
        keyCol=None,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def encode_training(self, dataset: DataFrame, model: AutoTargetEncoderModel) -> DataFrame:
        """Training rows for the stages behind this one."""
        folds = self.getOrDefault("outOfFold")
        if not folds:
            return model.transform(dataset)
        return out_of_fold_encode(
            with_fold(dataset, self.getOrDefault("keyCol"), folds, "__fold"),
            self.getInputCol(),
            self.getLabelCol(),
            "__fold",
            self.getOutputCol(),
            folds,
            self.getOrDefault("smoothing"),
            self.getOrDefault("maxBroadcastBytes"),
        ).drop("__fold")

    def _fit(self, dataset: DataFrame) -> AutoTargetEncoderModel:
        spark = dataset.sparkSession
        counts_path = scratch_path(spark, "category-counts")
        count = self.getOrDefault("countCol")
        columns = [F.col(self.getInputCol()).alias("category"), F.col(self.getLabelCol()).alias("label")]
        columns += [F.col(count).alias("count")] if count else []
        category_counts(dataset.select(*columns), ["category"], "label", "count" if count else None).write.parquet(
            counts_path
        )
        counts = spark.read.parquet(counts_path)
        total = counts.agg(
            F.sum("n").alias("rows"),
            F.sum("positives").alias("positives"),
            F.sum("unusable").alias("unusable"),
            F.sum(F.octet_length(F.col("category").cast("string")) + ROW_BYTES).alias("bytes"),
        ).first()
        if not total["rows"]:
            raise ValueError("no row with a label to fit on")
        if total["unusable"]:
            raise ValueError(f"{total['unusable']} labels are neither 0 nor 1")

        share = total["positives"] / total["rows"]
        encoding = smoothed(F.col("n"), F.col("positives"), F.lit(share), self.getOrDefault("smoothing"))
        encodings = counts.filter(F.col("category").isNotNull()).select(
            "category", "n", (F.col("positives") / F.col("n")).alias("mean"), encoding.alias("encoding")
        )
        model = AutoTargetEncoderModel(
            encodings=encodings, share=share, rows=total["rows"], lookup_bytes=total["bytes"] or 0
        )
        return self._copyValues(model)


class AutoTargetEncoderModel(Model, _TargetEncoderParams, MLReadable, MLWritable):
    """Replaces each category by its learned number."""

    def __init__(self, encodings: DataFrame, share: float, rows: int, lookup_bytes: int):
        super().__init__()
        self.encodings = encodings
        self.share = share
        self.rows = rows
        self.lookup_bytes = lookup_bytes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column = self.getInputCol()
        output = self.getOutputCol()
        lookup = self.encodings.select(F.col("category").alias(column), "n", F.col("encoding").alias(output))
        joined = join_lookup(
            dataset,
            lookup.withColumnRenamed("n", "__rows"),
            [column],
            lookup_bytes=self.lookup_bytes,
            rows_column="__rows",
            total_rows=self.rows,
            max_broadcast_bytes=self.getOrDefault("maxBroadcastBytes"),
        )
        return joined.withColumn(output, F.coalesce(F.col(output), F.lit(self.share)))

    def write(self) -> MLWriter:
        return _TargetEncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TargetEncoderReader(cls)


class _TargetEncoderWriter(MLWriter):
    def __init__(self, instance: AutoTargetEncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        model = self.instance
        DefaultParamsWriter.saveMetadata(
            model,
            path,
            self.sparkSession,
            extraMetadata={"share": model.share, "rows": model.rows, "lookupBytes": model.lookup_bytes},
        )
        model.encodings.write.parquet(f"{path}/encodings")


class _TargetEncoderReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> AutoTargetEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(
            encodings=self.sparkSession.read.parquet(f"{path}/encodings"),
            share=metadata["share"],
            rows=metadata["rows"],
            lookup_bytes=metadata["lookupBytes"],
        )
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def label_counts(df: DataFrame, category: str, label: str, fold: str) -> DataFrame:
    """Rows per category, label and fold, ``(category, label, fold, __count)``: what encoders of any choice of folds are fitted on.

    Columns keep their names, so an encoder with ``countCol="__count"`` takes the counts in place of the rows.
    """
    return df.groupBy(category, label, fold).agg(F.count(F.lit(1)).alias("__count"))


def encode_with_all(df: DataFrame, models: Sequence[AutoTargetEncoderModel], output: str) -> DataFrame:
    """``df`` with ``output``: an array of the encodings that each of several models of one column gives.

    The models' tables, one row per category, are joined with each other first, so ``df`` meets one lookup, however many models there are.
    """
    first = models[0]
    column = first.getInputCol()
    lookup = None
    for i, model in enumerate(models):
        own = model.encodings.select(F.col("category").alias("__category"), F.col("n").alias(f"n_{i}"), F.col("encoding").alias(f"e_{i}"))
        lookup = own if lookup is None else lookup.join(own, "__category", "full")
    encodings = F.array(*(F.coalesce(f"e_{i}", F.lit(model.share)) for i, model in enumerate(models)))
    most = F.greatest(*(F.coalesce(f"n_{i}", F.lit(0).cast("bigint")) for i in range(len(models))), F.lit(0).cast("bigint"))
    lookup = lookup.select("__category", encodings.alias(output), most.alias("__rows"))
    joined = join_lookup(
        df.withColumn("__category", F.col(column)),
        lookup,
        ["__category"],
        lookup_bytes=sum(model.lookup_bytes for model in models),
        rows_column="__rows",
        total_rows=max(model.rows for model in models),
        max_broadcast_bytes=first.getOrDefault("maxBroadcastBytes"),
    ).drop("__category")
    shares = F.array(*(F.lit(model.share) for model in models))
    return joined.withColumn(output, F.coalesce(output, shares))


def out_of_fold_encode(
    df: DataFrame,
    category: str,
    label: str,
    fold: str,
    output: str,
    folds: int,
    smoothing: str | float = "auto",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Encode training rows without their own label: each from the rows of the other folds only.

    ``fold`` holds integers in [0, folds). One aggregate per (category, fold) feeds all encodings: the
    counts for a fold are the category's totals minus that fold's own. The overall share leaves the fold out
    as well.
    """
    spark = df.sparkSession
    smoothing = checked_smoothing(smoothing)
    path = scratch_path(spark, "fold-counts")
    pairs = df.select(F.col(category).alias("category"), F.col(fold).alias("fold"), F.col(label).alias("label"))
    category_counts(pairs, ["category", "fold"], "label").write.parquet(path)
    counts = spark.read.parquet(path)

    bounds = counts.agg(F.min("fold").alias("low"), F.max("fold").alias("high"), F.count_if(F.col("fold").isNull()).alias("none")).first()
    whole = isinstance(df.schema[fold].dataType, IntegralType)
    if not whole or bounds["none"] or (bounds["low"] is not None and not 0 <= bounds["low"] <= bounds["high"] < folds):
        raise ValueError(f"column {fold!r} must hold integers in [0, {folds})")
    # one row per fold reaches the driver
    by_fold = {
        row["fold"]: row
        for row in counts.groupBy("fold")
        .agg(
            F.sum("n").alias("n"),
            F.sum("positives").alias("positives"),
            F.sum("unusable").alias("unusable"),
            F.sum(F.octet_length(F.col("category").cast("string")) + ROW_BYTES).alias("bytes"),
        )
        .collect()
    }
    if any(row["unusable"] for row in by_fold.values()):
        raise ValueError("labels must be 0 or 1")
    rows = sum(row["n"] for row in by_fold.values())
    positives = sum(row["positives"] for row in by_fold.values())
    shares = {
        number: (positives - row["positives"]) / (rows - row["n"])
        for number, row in by_fold.items()
        if rows > row["n"]
    }
    if len(by_fold) < 2:
        raise ValueError("out-of-fold encoding needs labelled rows in at least two folds")

    # Totals per category: at most one row per fold and category enters.
    known = counts.filter(F.col("category").isNotNull())
    totals = known.groupBy(F.col("category").alias("__category")).agg(
        F.sum("n").alias("all_n"), F.sum("positives").alias("all_positives")
    )
    joined = known.join(totals, F.col("category") == F.col("__category"))
    lookup = joined.select(
        F.col("category").alias(category),
        F.col("fold").alias(fold),
        F.col("n").alias("__rows"),
        smoothed(
            F.col("all_n") - F.col("n"),
            F.col("all_positives") - F.col("positives"),
            literal_map(shares, F.col("fold")),
            smoothing,
        ).alias(output),
    )
    encoded = join_lookup(
        df,
        lookup,
        [category, fold],
        lookup_bytes=sum(row["bytes"] or 0 for row in by_fold.values()),
        rows_column="__rows",
        total_rows=rows,
        max_broadcast_bytes=max_broadcast_bytes,
    )
    return encoded.withColumn(output, F.coalesce(F.col(output), literal_map(shares, F.col(fold))))
