"""Left join with a lookup table, planned by the lookup's measured size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from propensity.functions.literals import MAX_LITERAL_KEYS, literal_map

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
HOT_PARTS = 200


def join_lookup(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    *,
    lookup_bytes: int,
    rows_column: str,
    total_rows: int,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add the columns of ``lookup`` to the matching rows of ``df``; all rows of ``df`` stay, once each.

    ``lookup`` must be unique on ``on`` and must know, in ``rows_column``, how many of ``total_rows`` rows
    have each key. ``rows_column`` is not part of the result. NULL keys match nothing.

    * A lookup of at most ``max_broadcast_bytes`` is broadcast; ``df`` is not shuffled.
    * A larger one is split by those counts. Keys with more than 1/``HOT_PARTS`` of the rows are fewer than
      ``HOT_PARTS``, whatever the data, and are broadcast. One join by key then serves the other rows; rows that are settled,
      by a hot key or by having no key, carry a salt in it that no lookup row has, so they match nothing there and
      spread over all tasks. ``df`` is evaluated once. A key that is frequent in ``df`` but was rare or absent when the
      counts were taken is left to the skew handling of adaptive execution.
    """
    on = list(on)
    values = [name for name in lookup.columns if name not in (*on, rows_column)]

    def matches(prefix: str):
        return reduce(lambda a, b: a & b, [F.col(name) == F.col(f"{prefix}{name}") for name in on])

    def renamed(part: DataFrame, prefix: str) -> DataFrame:
        return part.drop(rows_column).withColumnsRenamed({name: f"{prefix}{name}" for name in (*on, *values)})

    if lookup_bytes <= max_broadcast_bytes:
        small = renamed(lookup, "__hot_")
        joined = df.join(F.broadcast(small), matches("__hot_"), "left")
        return joined.withColumnsRenamed({f"__hot_{name}": name for name in values}).drop(*(f"__hot_{name}" for name in on))

    is_hot = F.col(rows_column) * HOT_PARTS > F.lit(total_rows)
    hot = renamed(lookup.filter(is_hot), "__hot_")
    cold = renamed(lookup.filter(~is_hot), "__cold_").withColumn("__cold_salt", F.lit(-1).cast("bigint"))
    tagged = df.join(F.broadcast(hot), matches("__hot_"), "left")
    without_key = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in on])
    settled = F.col(f"__hot_{on[0]}").isNotNull() | without_key
    salted = tagged.withColumn("__salt", F.when(settled, F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    joined = salted.join(cold, matches("__cold_") & (F.col("__salt") == F.col("__cold_salt")), "left")
    found = {name: F.coalesce(f"__hot_{name}", f"__cold_{name}") for name in values}
    return joined.withColumns(found).select(*df.columns, *values)


def map_values(df: DataFrame, mapping: Mapping, key: str, output: str, value_type: str = "double") -> DataFrame:
    """``df`` with ``output``: the value of column ``key`` in a mapping of any size, NULL where there is none.

    A small mapping is an expression in the plan. A larger one becomes a table, which is joined by its measured size.
    """
    if len(mapping) <= MAX_LITERAL_KEYS:
        return df.withColumn(output, literal_map(mapping, F.col(key)).cast(value_type))
    entry, kind = f"__{output}_key", df.schema[key].dataType
    fields = StructType([StructField(entry, kind), *StructType.fromDDL(f"`{output}` {value_type}").fields])
    table = df.sparkSession.createDataFrame([(k, v) for k, v in mapping.items() if k is not None], fields)
    size = sum(len(str(k)) + len(str(v)) + 32 for k, v in mapping.items())
    joined = join_lookup(
        df.withColumn(entry, F.col(key)),
        table.withColumn("__rows", F.lit(0)),  # no counts: frequent keys are left to adaptive execution
        [entry],
        lookup_bytes=size,
        rows_column="__rows",
        total_rows=0,
    )
    return joined.drop(entry)
