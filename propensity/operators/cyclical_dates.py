"""Cyclical date encoding as a pipeline stage."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.functions.dates import PERIODS, cyclical


class CyclicalDateTransformer(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Replace date columns by sine/cosine pairs of calendar parts.

    Outputs are named ``<prefix>_<part>_sin`` and ``<prefix>_<part>_cos``; prefixes default to the input
    names. A saved pipeline that starts with this stage takes raw date columns.
    """

    parts = Param(
        Params._dummy(), "parts", "calendar parts to encode", typeConverter=TypeConverters.toListString
    )
    prefixes = Param(
        Params._dummy(), "prefixes", "output prefix per input column", typeConverter=TypeConverters.toListString
    )
    dropInputs = Param(
        Params._dummy(), "dropInputs", "whether the dates are dropped", typeConverter=TypeConverters.toBoolean
    )

    @keyword_only
    def __init__(self, *, inputCols=None, parts=None, prefixes=None, dropInputs=None):
        super().__init__()
        self._setDefault(parts=["month", "dayofyear"], dropInputs=True)
        self._set(**self._input_kwargs)

    def _pairs(self):
        columns = self.getInputCols()
        prefixes = self.getOrDefault("prefixes") if self.isSet("prefixes") else columns
        if len(prefixes) != len(columns):
            raise ValueError("prefixes and inputCols differ in length")
        unknown = set(self.getOrDefault("parts")) - set(PERIODS)
        if unknown:
            raise ValueError(f"unknown calendar parts {sorted(unknown)}; known: {sorted(PERIODS)}")
        return [
            (column, f"{prefix}_{part}", part)
            for column, prefix in zip(columns, prefixes)
            for part in self.getOrDefault("parts")
        ]

    def output_columns(self) -> list[str]:
        """Names of the added columns, in order."""
        return [f"{name}_{wave}" for _, name, _ in self._pairs() for wave in ("sin", "cos")]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        added = {}
        for column, name, part in self._pairs():
            added[f"{name}_sin"], added[f"{name}_cos"] = cyclical(part, F.col(column))
        encoded = dataset.withColumns(added)
        return encoded.drop(*self.getInputCols()) if self.getOrDefault("dropInputs") else encoded
