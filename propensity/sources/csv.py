"""CSV scan and sink under a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from propensity.schema import APPOINTMENT_SCHEMA


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = APPOINTMENT_SCHEMA,
    null_token: str = "null",
    mode: str = "PERMISSIVE",
    corrupt_column: str | None = None,
) -> DataFrame:
    """Read CSV files with a header, binding columns to ``schema`` by position.

    Cells equal to ``null_token``, empty cells and cells that do not parse under their type become NULL.
    ``corrupt_column`` keeps the text of rows with such a bad cell in one more string column, whichever columns are read later.
    Lines are records, so that large files are split between tasks.
    """
    reader = (
        spark.read.format("csv")
        .option("header", "true")
        .option("nullValue", null_token)
        .option("enforceSchema", "true")
        .option("mode", mode)
    )
    if corrupt_column:
        schema = T.StructType([*schema.fields, T.StructField(corrupt_column, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column).option("columnPruning", "false")
    return reader.schema(schema).load(path)


def quarantine(df: DataFrame, corrupt_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a scan without and with a bad cell, both with the columns of the scan's schema; the latter keep their text as well.

    Each side scans the files by itself; nothing is cached.
    """
    bad = df[corrupt_column].isNotNull()
    return df.filter(~bad).drop(corrupt_column), df.filter(bad)


def write_csv(
    df: DataFrame, path: str, null_token: str = "null", mode: str = "overwrite", empty_token: str = '""'
) -> None:
    """Write CSV files with a header; NULL is spelled ``null_token``, an empty text ``empty_token``.

    A pair of quotes is read as an empty text, which is a bad cell under any other type; nothing between the separators is read as NULL.
    """
    (
        df.write.format("csv")
        .option("header", "true")
        .option("nullValue", null_token)
        .option("emptyValue", empty_token)
        .mode(mode)
        .save(path)
    )
