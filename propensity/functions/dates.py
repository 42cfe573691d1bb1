"""Calendar parts of dates and their cyclical encoding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar part -> length of its cycle. A leap year's day 366 runs past the circle.
PERIODS = {"month": 12, "dayofyear": 365, "dayofweek": 7}


def date_part(name: str, date: Column) -> Column:
    """Month (1-12), day of year (1-366) or day of week (1 = Sunday)."""
    if name not in PERIODS:
        raise ValueError(f"unknown calendar part {name!r}; known: {sorted(PERIODS)}")
    return getattr(F, name)(date)


def cyclical(name: str, date: Column) -> tuple[Column, Column]:
    """Sine and cosine of a calendar part on its circle."""
    angle = F.lit(2 * math.pi) * date_part(name, date) / PERIODS[name]
    return F.sin(angle), F.cos(angle)


def days_between(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``."""
    return F.datediff(end, start)
