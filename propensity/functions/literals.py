"""Literal lookup maps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LITERAL_KEYS = 1000


def literal_map(mapping: Mapping, key: Column) -> Column:
    """Value of ``key`` in a small fixed mapping, NULL where the mapping has no such key.

    The mapping is part of the plan text, hence the limit; larger mappings are joined
    (``propensity.operators.map_values``).
    """
    if not 0 < len(mapping) <= MAX_LITERAL_KEYS:
        raise ValueError(f"a literal map holds 1 to {MAX_LITERAL_KEYS} keys, got {len(mapping)}")
    entries = [F.lit(part) for item in mapping.items() for part in item]
    return F.create_map(*entries)[key]
