"""Missing-value report and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column name as a reference that takes dots literally."""
    return "`" + name.replace("`", "``") + "`"


def is_empty(df: DataFrame, name: str, nan_is_null: bool = False) -> Column:
    """Whether a field is NULL; with ``nan_is_null`` also whether it is NaN."""
    column = F.col(quoted(name))
    if nan_is_null and isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def null_counts(df: DataFrame, nan_is_null: bool = False) -> list[Column]:
    """One aggregate per column: its number of empty fields."""
    return [F.count_if(is_empty(df, name, nan_is_null)).alias(name) for name in df.columns]


def missing_report(df: DataFrame) -> DataFrame:
    """NULL count per column as rows ``(column, missing_count)``, most missing first.

    One pass with a global aggregate, turned into rows on the executors. The turned row stays in the
    aggregate's single partition, so the sort over its few rows needs no further exchange.
    """
    totals = df.agg(*null_counts(df))
    pairs = [F.struct(F.lit(name).alias("c"), F.col(quoted(name)).alias("n")) for name in df.columns]
    return (
        totals.select(F.inline(F.array(*pairs)).alias("column", "missing_count"))
        .orderBy(F.col("missing_count").desc(), "column")
    )


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows as a one-row frame ``(n)``."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows per label value, ``(label, n)``, in one pass; a NULL label is a class of its own here."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
