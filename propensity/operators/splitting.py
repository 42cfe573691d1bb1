"""Reproducible splits, folds and samples.

The side of a row depends on its key only, never on file layout or partitioning, so that a rerun, another
engine and a table read back all agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.functions.keyhash import FOLD_INCREMENT, FOLD_MULTIPLIER, hash_bucket


def with_split(df: DataFrame, key: str, train_percent: int = 80) -> DataFrame:
    """Add ``bucket`` (0-99, from the key) and ``split`` ('train' or 'test')."""
    bucket = hash_bucket(F.col(key), 100)
    return df.withColumns(
        {"bucket": bucket, "split": F.when(bucket < train_percent, "train").otherwise("test")}
    )


def train_test_split(df: DataFrame, key: str, train_percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The two sides of the key split as filtered views of ``df``."""
    is_train = hash_bucket(F.col(key), 100) < train_percent
    return df.filter(is_train), df.filter(~is_train)


def random_split(df: DataFrame, train_share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Bernoulli split by a seeded generator. Its outcome changes with the layout of ``df``."""
    train, test = df.randomSplit([train_share, 1 - train_share], seed=seed)
    return train, test


def with_fold(df: DataFrame, key: str, folds: int = 3, column: str = "fold") -> DataFrame:
    """Add the cross-validation fold of each row, an int in [0, folds), from its key.

    Folds come from another hash than the split, so that within either side of it all folds are alike.
    """
    fold = hash_bucket(F.col(key), folds, FOLD_MULTIPLIER, FOLD_INCREMENT)
    return df.withColumn(column, fold.cast("int"))


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows per side, ``(split, n)``, of a frame with a ``split`` column."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest keys, as example input; a distributed top-n, not a full sort."""
    return df.orderBy(key).limit(n)
