"""Vector columns as scalar columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_elements(vector: str, names: Sequence[str]) -> list[Column]:
    """The elements of a vector column, one column per name."""
    elements = vector_to_array(F.col(vector))
    return [elements[i].alias(name) for i, name in enumerate(names)]
