"""Declared feature sets and the pipeline stages that build them.

``base8``     the eight numeric columns
``backup17``  base8, eight cyclical date columns and the one-hot gender
``full``      backup17 and the target-encoded neighborhood
``columns``   the numeric columns that the caller names, and nothing else

Every set but the last runs the gender indexer, so they drop rows without a known gender. All drop rows with NULL
or NaN in a numeric input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import MinMaxScaler, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame

from propensity.operators.binning import QuantileBins
from propensity.operators.cyclical_dates import CyclicalDateTransformer
from propensity.operators.target_encoding import AutoTargetEncoder
from propensity.schema import (
    BASE_COLUMNS,
    DATE_COLUMNS,
    DATE_PREFIXES,
    HIGH_CARDINALITY,
    LABEL,
    LOW_CARDINALITY,
    ROW_KEY,
)

FEATURES = "features"
SCALED_FEATURES = "scaled_features"
BINNED_FEATURES = "binned_features"
FEATURE_SETS = ("base8", "backup17", "full", "columns")


def needed_columns(feature_set: str = "full", columns: Sequence[str] = ()) -> list[str]:
    """Columns that a feature set reads."""
    if feature_set == "columns":
        return list(columns)
    dates = DATE_COLUMNS if feature_set in ("backup17", "full") else []
    categories = [LOW_CARDINALITY] + ([HIGH_CARDINALITY] if feature_set == "full" else [])
    return [*BASE_COLUMNS, *dates, *categories]


def feature_stages(
    feature_set: str = "full",
    scale: bool = False,
    date_parts: Sequence[str] = ("month", "dayofyear"),
    smoothing: str | float = "auto",
    out_of_fold: int = 0,
    key: str = ROW_KEY,
    columns: Sequence[str] = (),
    binned: bool = False,
) -> list[Estimator | Transformer]:
    """The unfitted stages that turn a cleaned row into the ``features`` vector.

    The target encoder comes first, so that it learns from all training rows, also those that a later stage
    drops. With ``out_of_fold`` folds (by ``key``) a training pipeline fits what follows on encodings that leave
    out a row's own label. ``columns`` names the inputs of the set of that name. ``scale`` appends a min-max scaler, fitted with the rest, whose output is ``scaled_features``.
    ``binned`` appends ``binned_features``, the same vector with numbers replaced by their quantile bins, for tree learners.
    """
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {feature_set!r}; known: {FEATURE_SETS}")
    stages: list[Estimator | Transformer] = []
    if feature_set == "columns":
        if not columns:
            raise ValueError("the feature set 'columns' needs columns")
        stages.append(VectorAssembler(inputCols=list(columns), outputCol=FEATURES, handleInvalid="skip"))
        stages += binned_features(list(columns)) if binned else []
        return [*stages, scaled_features()] if scale else stages
    inputs = list(BASE_COLUMNS)
    if feature_set == "full":
        encoded = f"{HIGH_CARDINALITY}_te"
        stages.append(
            AutoTargetEncoder(
                inputCol=HIGH_CARDINALITY,
                outputCol=encoded,
                labelCol=LABEL,
                smoothing=smoothing,
                outOfFold=out_of_fold,
                keyCol=key,
            )
        )
    if feature_set in ("backup17", "full"):
        dates = CyclicalDateTransformer(
            inputCols=DATE_COLUMNS, prefixes=DATE_PREFIXES, parts=list(date_parts)
        )
        stages.append(dates)
        inputs += dates.output_columns()
    index, vector = f"{LOW_CARDINALITY}_index", f"{LOW_CARDINALITY}_vec"
    stages.append(StringIndexer(inputCol=LOW_CARDINALITY, outputCol=index, handleInvalid="skip"))
    stages.append(OneHotEncoder(inputCol=index, outputCol=vector))
    if feature_set in ("backup17", "full"):
        inputs.append(vector)
    if feature_set == "full":
        inputs.append(encoded)
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="skip"))
    if binned:
        stages += binned_features([name for name in inputs if name != vector], [vector] if vector in inputs else [])
    if scale:
        stages.append(scaled_features())
    return stages


def binned_features(numbers: list[str], others: Sequence[str] = ()) -> list[Estimator | Transformer]:
    """Stages behind the assembler, which has dropped rows with missing numbers: bins of ``numbers``, assembled with ``others``."""
    bins = [f"{name}_bin" for name in numbers]
    return [
        QuantileBins(inputCols=numbers, outputCols=bins),
        VectorAssembler(inputCols=[*bins, *others], outputCol=BINNED_FEATURES),
    ]


def scaled_features() -> MinMaxScaler:
    """Min-max scaler of the feature vector to [0, 1]; a constant feature becomes 0.5."""
    return MinMaxScaler(inputCol=FEATURES, outputCol=SCALED_FEATURES)


def feature_names(transformed: DataFrame, column: str = FEATURES) -> list[str]:
    """Names of the vector's elements, from the attributes the assembler attaches."""
    attributes = transformed.schema[column].metadata["ml_attr"]["attrs"]
    named = [(attribute["idx"], attribute["name"]) for group in attributes.values() for attribute in group]
    return [name for _, name in sorted(named)]


def learner_of(model: PipelineModel) -> Transformer:
    """The fitted learner, the last stage of a pipeline."""
    return model.stages[-1]
