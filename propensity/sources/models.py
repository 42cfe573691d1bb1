"""Saved pipelines for batch scoring."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_pipeline(model: PipelineModel, path: str) -> None:
    """Save a fitted pipeline, replacing what is at ``path``.

    A loaded target encoder reads its lookup from where it was saved, so a pipeline cannot replace itself.
    """
    folder = urlparse(path).path.rstrip("/") + "/"
    lookups = [stage.encodings for stage in model.stages if hasattr(stage, "encodings")]
    if any(urlparse(file).path.startswith(folder) for lookup in lookups for file in lookup.inputFiles()):
        raise ValueError(f"this pipeline was loaded from {path}; save it to another path")
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    """Load a fitted pipeline; score new rows with its ``transform``."""
    return PipelineModel.load(path)


def write_scores(scored: DataFrame, path: str, model: str, batch: str) -> None:
    """Write scored rows to the score table at ``path``, partitioned by ``model`` (which model scored them) and the column ``batch``.

    What the table holds of the same model and batches is replaced, the rest stays. So a run that is repeated, for all of its batches or for some,
    leaves the same table, and one that failed is repaired by running it again: files show up only when the whole job commits.
    """
    rows = scored.withColumns({"model": F.lit(model), "batch": F.col(batch)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "batch").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scan of a score table; filters on ``model`` and ``batch`` pick folders."""
    return spark.read.parquet(path)
