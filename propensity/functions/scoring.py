"""Linear scores from given coefficients."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_score(
    coefficients: Mapping[str, float], intercept: float, threshold: float = 0.5
) -> dict[str, Column]:
    """Margin, probability and prediction of a logistic model with known coefficients.

    A NULL in any input gives NULL in all three.
    """
    terms = [F.col(name) * F.lit(float(value)) for name, value in coefficients.items()]
    margin = reduce(lambda a, b: a + b, terms, F.lit(float(intercept)))
    probability = 1.0 / (1.0 + F.exp(-margin))
    return {
        "margin": margin,
        "probability": probability,
        "prediction": (probability > threshold).cast("double"),
    }
