"""The corpus pipeline: operators of ``propensity.llm`` in a row, each over all that the one before kept.

All stages take very long texts whole, pass further columns on whatever their names, and leave an empty table empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from propensity.llm.bpe import encode_and_decode
from propensity.llm.common import read_table, stage
from propensity.llm.exact_dedup import drop_exact_duplicates
from propensity.llm.mixing import apply_mix
from propensity.llm.near_dedup import drop_near_duplicates
from propensity.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones, does not predict as toxic.

    NULL and empty texts stay unless the bias alone rejects them; repeated rows and NULL ids are judged each.
    """
    return drop_toxic(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; NULL texts equal empty ones.

    Rows that repeat id and text leave one. A row with a NULL id stays, but for its repeats.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id: five words to a shingle, similarity 0.8.

    Texts without a word, and rows with a NULL id, belong to no group and stay; rows that repeat id and text leave one.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for; the one at a source's cut in part.

    A NULL source is one more source. Texts without a word have nothing to take, and go.
    """
    return apply_mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (packed little-endian unsigned 32-bit integers), and the bytes decoded from them; NULL texts have none."""
    return encode_and_decode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("byte bpe", byte_bpe),
]

#: toxicity scores and token ids have no SQL form; tests compare the pipeline with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
