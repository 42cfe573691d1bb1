"""Renaming, casting and dropping of rows and columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensity.operators.profiling import is_empty, null_counts, quoted


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; names with dots are taken literally, absent ones are ignored."""
    return df.withColumnsRenamed(dict(names))


def columns_of_type(df: DataFrame, *types: type[T.DataType]) -> list[str]:
    """Names of the columns whose type is one of ``types``, in frame order."""
    return [field.name for field in df.schema.fields if isinstance(field.dataType, types)]


def cast_to_double(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast ``columns`` to double in one projection; by default all int and boolean ones.

    64-bit integers are left alone by default: they are identifiers, which a double cannot hold exactly.
    """
    chosen = set(columns_of_type(df, T.IntegerType, T.BooleanType) if columns is None else columns)
    return df.selectExpr(
        *[
            f"CAST({quoted(name)} AS DOUBLE) AS {quoted(name)}" if name in chosen else quoted(name)
            for name in df.columns
        ]
    )


def drop_null_labels(df: DataFrame, label: str) -> DataFrame:
    """Drop rows without a label: learners and metrics reject them."""
    return df.filter(F.col(label).isNotNull())


def skip_invalid_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with NULL or NaN in any of ``columns``."""
    return df.dropna(how="any", subset=list(columns))


def drop_sparse_rows(df: DataFrame, max_null_percent: int = 80, nan_is_null: bool = False) -> DataFrame:
    """Keep rows in which at most ``max_null_percent`` of the fields are NULL (or NaN, with ``nan_is_null``)."""
    empty = reduce(add, [is_empty(df, name, nan_is_null).cast("int") for name in df.columns])
    return df.filter(empty * 100 <= len(df.columns) * max_null_percent)


def drop_sparse_columns(df: DataFrame, max_null_percent: int = 80, nan_is_null: bool = False) -> DataFrame:
    """Drop the columns in which more than ``max_null_percent`` of the rows are NULL (or NaN, with ``nan_is_null``).

    The result's schema depends on the data, so one aggregate runs now; it returns a single row.
    """
    nulls = F.struct(*null_counts(df, nan_is_null))
    counts = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("nulls")).first()
    limit = counts["rows"] * max_null_percent
    sparse = [name for name, nulls in zip(df.columns, counts["nulls"]) if (nulls or 0) * 100 > limit]
    return df.drop(*sparse)
