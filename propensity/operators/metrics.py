"""Metrics of binary classifiers as distributed aggregates.

All are unweighted and expect rows without NULL labels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propensity.operators.curves import curve_areas

RANGES = 128


def score_counts(df: DataFrame, label: str, prediction: str, score: str) -> DataFrame:
    """Rows per ``score``: ``pos`` and ``neg`` by label, ``pos_hit`` and ``neg_hit`` of them predicted as 1.

    The common base of all metrics of one binary model: :func:`binary_metrics` has them all from this one aggregate.
    """
    hit = F.col(prediction) == 1
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
        F.count_if((F.col(label) == 1) & hit).alias("pos_hit"),
        F.count_if((F.col(label) == 0) & hit).alias("neg_hit"),
    )


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction", count: str | None = None
) -> DataFrame:
    """Rows per ``(label, prediction)``; ``count`` names a column of row counts of pre-aggregated input."""
    rows = F.sum(count) if count else F.count(F.lit(1))
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(rows.alias("n"))


def _ratio(part, whole):
    return F.when(whole > 0, part / whole).otherwise(0.0)


def per_class_metrics(confusion: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of each class of a confusion matrix.

    Ratios with an empty denominator are 0. A confusion matrix has a row per pair of classes, so one task
    handles it.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    as_label = F.struct(
        F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
        hit.alias("hits"),
    )
    as_prediction = F.struct(
        F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"),
        F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits"),
    )
    classes = (
        confusion.coalesce(1)
        .select(F.inline(F.array(as_label, as_prediction)))
        .groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    return classes.select(
        "class",
        "support",
        "predicted",
        "hits",
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def weighted_metrics(confusion: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 as one row.

    Weighted recall equals accuracy by definition; the recall of the negative class, which it is easily
    mistaken for, is ``recall_negative``.
    """
    classes = per_class_metrics(confusion)
    rows = F.sum("support")

    def weighted(name):
        return F.sum(F.col("support") * F.col(name)) / rows

    return classes.agg(
        rows.alias("n"),
        (F.sum("hits") / rows).alias("accuracy"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("f1"),
        F.max(F.when(F.col("class") == 0, F.col("recall"))).alias("recall_negative"),
    )


def area_under_roc(df: DataFrame, label: str, score: str, count: str | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counting half, as one row ``(positives, negatives, auc)``.

    ``count`` names a column of row counts of pre-aggregated input. ``auc`` is NULL if a class is missing. Equal scores collapse before they are
    shuffled, then the distinct ones are summed up range by range (:func:`curve_areas`), in as many tasks as their number
    asks for. Scores that are NULL or NaN are refused.
    """
    rows = F.col(count) if count else F.lit(1)
    per_score = df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, rows).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, rows).otherwise(0)).alias("neg"),
    )
    area = curve_areas(per_score.withColumn("curve", F.lit(0)))
    whole = {name: F.coalesce(F.max(name), F.lit(0).cast("bigint")).alias(name) for name in ("positives", "negatives")}
    return area.agg(*whole.values(), F.max("auc").alias("auc"))


def area_of_scores(per_score: DataFrame, ranges: int | None = None) -> DataFrame:
    """:func:`area_under_roc` of counts per distinct score (``score``, ``pos``, ``neg``); sums of further columns are added.

    Each positive row is worth the negatives below it plus half of those tied with it. Equal scores have
    collapsed, so a hot score is one row. The distinct scores are dealt to ``ranges`` ranges (as many as a shuffle has partitions,
    but ``RANGES`` at least) between their approximate percentiles, in one shuffle, and summed up within each; the ranges then add the negatives of all lower ones. Any
    boundaries give the exact value: counts are exact integers, so it does not depend on the partitioning either.
    """
    ranges = ranges or max(RANGES, int(per_score.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    zero = F.lit(0).cast("bigint")
    sums = [name for name in per_score.columns if name != "score"]
    steps = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    # names all columns, so that the boundaries come from the very shuffle that the sums come from
    counted = reduce(lambda a, b: a + b, [F.col(name) for name in sums]) >= 0
    edges = per_score.select(F.percentile_approx(F.when(counted, F.col("score")), steps)).scalar()
    number = F.coalesce(F.size(F.filter("edges", lambda edge: edge < F.col("score"))), F.lit(0))
    ranged = per_score.withColumn("edges", edges).select("score", *sums, number.alias("range")).repartition("range")
    lower_scores = (
        Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    )
    below = F.coalesce(F.sum("neg").over(lower_scores), zero)

    def product(a, b):
        # counts may exceed 64 bits once multiplied
        return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")

    summed = (
        ranged.withColumn("twice_won", product(F.col("pos"), 2 * below + F.col("neg")))
        .groupBy("range")
        .agg(*(F.sum(name).alias(name) for name in [*sums, "twice_won"]))
    )
    lower_ranges = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    total = summed.withColumn("below", F.coalesce(F.sum("neg").over(lower_ranges), zero)).agg(
        F.sum(F.col("twice_won") + 2 * product(F.col("pos"), F.col("below"))).alias("twice_won"),
        *(F.coalesce(F.sum(name), zero).alias(name) for name in sums),
    )
    pairs = F.col("pos").cast("double") * F.col("neg").cast("double")
    return total.select(
        F.col("pos").alias("positives"),
        F.col("neg").alias("negatives"),
        F.when(pairs > 0, F.col("twice_won").cast("double") / (2 * pairs)).alias("auc"),
        *(name for name in sums if name not in ("pos", "neg")),
    )


def binary_metrics(counts: DataFrame) -> DataFrame:
    """All metrics of :func:`score_counts` as one row: those of :func:`weighted_metrics` and ``auc``, from one pass over the scores."""
    return metrics_of_sums(area_of_scores(counts))


def metrics_of_sums(row: DataFrame, *keys: str) -> DataFrame:
    """All metrics of rows with ``positives``, ``negatives``, ``pos_hit``, ``neg_hit`` and ``auc``, next to the columns ``keys``."""
    hits = {1: F.col("pos_hit"), 0: F.col("negatives") - F.col("neg_hit")}
    support = {1: F.col("positives"), 0: F.col("negatives")}
    predicted = {1: F.col("pos_hit") + F.col("neg_hit")}
    predicted[0] = support[0] + support[1] - predicted[1]
    rows = support[0] + support[1]

    def weighted(values):
        return (support[0] * values[0] + support[1] * values[1]) / rows

    recall = {c: _ratio(hits[c], support[c]) for c in (0, 1)}
    return row.select(
        *keys,
        rows.alias("n"),
        ((hits[0] + hits[1]) / rows).alias("accuracy"),
        weighted({c: _ratio(hits[c], predicted[c]) for c in (0, 1)}).alias("weighted_precision"),
        weighted(recall).alias("weighted_recall"),
        weighted({c: _ratio(2 * hits[c], support[c] + predicted[c]) for c in (0, 1)}).alias("f1"),
        F.when((support[0] > 0) | (predicted[0] > 0), recall[0]).alias("recall_negative"),
        "auc",
    )
