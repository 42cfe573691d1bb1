"""Class weights for imbalanced labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.operators.profiling import class_balance
from propensity.schema import WEIGHT

# A missed appointment weighs four times an attended one.
POSITIVE_WEIGHT = 0.2
NEGATIVE_WEIGHT = 0.8


def with_class_weights(
    df: DataFrame,
    label: str,
    positive: float = POSITIVE_WEIGHT,
    negative: float = NEGATIVE_WEIGHT,
    column: str = WEIGHT,
) -> DataFrame:
    """Add constant class weights: ``positive`` where the label is 1, else ``negative``."""
    return df.withColumn(column, F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.lit(negative)))


def balanced_weights(df: DataFrame, label: str) -> tuple[float, float]:
    """The balanced weights of :func:`with_balanced_weights` as two numbers, positive first.

    For training input: the class counts are taken once, now, instead of in every pass over the weighted frame.
    At most two rows reach the driver.
    """
    labelled = df.filter(F.col(label).isin(0.0, 1.0))
    sizes = {row[label]: row["n"] for row in class_balance(labelled, label).collect()}
    per_class = sum(sizes.values()) / max(len(sizes), 1)
    return tuple(per_class / sizes[value] if value in sizes else 1.0 for value in (1.0, 0.0))


def with_balanced_weights(df: DataFrame, label: str, column: str = WEIGHT) -> DataFrame:
    """Weight each row by rows / (classes * rows of its class), so that the two classes weigh the same.

    Rows whose label is not 0 or 1 are dropped, which bounds the broadcast class table to two rows.
    """
    labelled = df.filter(F.col(label).isin(0.0, 1.0))
    sizes = class_balance(labelled, label).withColumnRenamed(label, "__class")
    totals = sizes.agg(F.sum("n") / F.count(F.lit(1))).scalar()
    weights = sizes.select("__class", (totals / F.col("n")).alias(column))
    return labelled.join(F.broadcast(weights), F.col(label) == F.col("__class")).drop("__class")
