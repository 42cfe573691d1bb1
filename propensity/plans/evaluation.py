"""Metric tables of scored frames and the comparison of models."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propensity.operators.curves import curve_areas
from propensity.operators.metrics import binary_metrics, metrics_of_sums, score_counts
from propensity.schema import LABEL

METRICS = ["accuracy", "f1", "weighted_precision", "weighted_recall", "recall_negative", "auc"]


def with_score(predictions: DataFrame, column: str = "score") -> DataFrame:
    """Add the raw score of the positive class as a plain column."""
    return predictions.withColumn(column, vector_to_array(F.col("rawPrediction"))[1])


def model_metrics(predictions: DataFrame, model: str) -> DataFrame:
    """All metrics of one scored frame as rows ``(model, metric, value)``.

    The rows are scored and grouped once; all metrics come from that grouping.
    """
    scored = with_score(predictions).select(
        F.col(LABEL).alias("label"), F.col("prediction"), F.col("score")
    )
    counts = score_counts(scored, "label", "prediction", "score")
    pairs = [F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in METRICS]
    return binary_metrics(counts).select(F.lit(model).alias("model"), F.inline(F.array(*pairs)))


def leaderboard(predictions: Mapping[str, DataFrame]) -> DataFrame:
    """Metrics of several models, ``(rank, model, metric, value)``, best area under ROC first.

    The ranking runs over one row per model and metric. Models that score the same rows are better compared by
    :func:`compare_models`, which reads these once.
    """
    return _ranked(reduce(DataFrame.unionByName, [model_metrics(df, name) for name, df in predictions.items()]))


def compare_models(models: Mapping[str, Transformer], rows: DataFrame) -> DataFrame:
    """:func:`leaderboard` of fitted models on the same rows: one scan, one grouping, all areas together.

    Each row is scored by all models and becomes a row per model, ``(curve, score)``; equal scores of a model collapse
    before the shuffle. The areas of all models are summed up range by range at once (:func:`propensity.operators.curve_areas`).
    """
    scored = rows.withColumnRenamed(LABEL, "label")
    for i, model in enumerate(models.values()):
        own = model.copy().setRawPredictionCol(f"raw_{i}").setProbabilityCol(f"probability_{i}").setPredictionCol(f"prediction_{i}")
        scored = own.transform(scored)
    each = [
        F.struct(F.lit(i).alias("curve"), vector_to_array(f"raw_{i}")[1].alias("score"), F.col(f"prediction_{i}").alias("prediction"))
        for i in range(len(models))
    ]
    hit = F.col("prediction") == 1
    counts = scored.select("label", F.inline(F.array(*each))).groupBy("curve", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg"),
        F.count_if((F.col("label") == 1) & hit).alias("pos_hit"),
        F.count_if((F.col("label") == 0) & hit).alias("neg_hit"),
    )
    hits = counts.groupBy("curve").agg(F.sum("pos_hit").alias("pos_hit"), F.sum("neg_hit").alias("neg_hit"))
    names = F.array(*map(F.lit, models))
    sums = curve_areas(counts).join(hits, "curve").withColumn("model", F.get(names, F.col("curve")))
    pairs = [F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in METRICS]
    return _ranked(metrics_of_sums(sums, "model").select("model", F.inline(F.array(*pairs))))


def _ranked(metrics: DataFrame) -> DataFrame:
    auc = F.max(F.when(F.col("metric") == "auc", F.col("value"))).over(Window.partitionBy("model"))
    ranked = metrics.withColumn("auc", auc).withColumn(
        "rank", F.dense_rank().over(Window.orderBy(F.col("auc").desc(), "model")).cast("bigint")
    )
    return ranked.select("rank", "model", "metric", "value").orderBy("rank", "metric")
