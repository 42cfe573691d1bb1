"""Running sums over a total order, without one task that sees a whole group.

Rows are dealt to ranges of the order and written with their range's number. Few numbers per range tell what
lies before it; rows then only need the sums inside their range. A group may span many ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propensity.llm.common import stage


def deal_ranges(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` range-partitioned by ``order``, staged, with the column ``range_id``, which rises with the order."""
    return stage(df.repartitionByRange(*order).withColumn("range_id", F.spark_partition_id()), name)


def range_totals(ranged: DataFrame, group: str, **sums: str) -> DataFrame:
    """Per ``group`` and range the sum of each column (``new=column``), and as ``new_before`` that of earlier ranges.

    One row per range and group that meet: at most the number of ranges plus that of groups.
    """
    totals = ranged.groupBy(group, "range_id").agg(*(F.sum(column).alias(new) for new, column in sums.items()))
    earlier = Window.partitionBy(group).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"{new}_before": F.coalesce(F.sum(new).over(earlier), F.lit(0).cast("bigint")) for new in sums}
    return totals.withColumns(before)


def sum_within(ranged: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Adds ``within``: the sum of ``value`` over earlier rows of the same group and range."""
    earlier = Window.partitionBy(group, "range_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("within", F.coalesce(F.sum(value).over(earlier), F.lit(0).cast("bigint")))
